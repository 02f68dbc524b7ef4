"""A corpus from raw documents: language ID, near-dedup, benchmark decontamination, mixing and sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadline.llm import decontamination, langid, mixing, neardup, sharding
from threadline.durable import written

#: Languages that stay; None: all that the labelled documents teach.
LANGUAGES: list[str] | None = None
WEIGHTS = [3.0, 1.0, 2.0]
SHARDS = 8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of LANGUAGES. Learned as in the language query: from labelled documents that aren't held out.

    Texts that are null, empty or without letters are undecided and go. Rows are judged each by itself, repeated ones too; a
    table without labelled rows leaves every text undecided; an empty table gives an empty one. Other columns pass through.
    """
    labelled = spark.read.parquet(f"{sf_dir}/documents.parquet").where(~langid.held_out())
    return langid.keep_languages(docs, langid.train(labelled), LANGUAGES)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the least doc_id.

    Rows with a null doc_id stay, and null texts are classes of their own; empty texts are one class. Of rows that repeat the least
    id, the one whose text has the least MD5 stays, and of equal rows one. An empty table gives an empty one.
    """
    return neardup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in windows of benchmark items.

    Null and empty texts stay, and rows are judged each by itself, repeated ones too. An empty benchmark leaves all rows.
    """
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for, twice at most.

    Null sources are one source, the last by name; texts without words are never taken, nor is a source without words. Repeated
    rows and null ids count each by itself; ties of finish times go by the shuffle key. An empty table gives an empty one.
    """
    return mixing.mix_sources(docs, WEIGHTS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, dealt into shards of the same mixture, with shard and slot (columns of these names are replaced).

    Null sources are one source; rows that share an id, null included, go by a hash of all columns, and equal rows are
    interchangeable. An empty table gives an empty one.
    """
    return sharding.assign_shards(docs, SHARDS)


STAGES = [("language ID", language_id), ("near-dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: Language ID and near-dedup have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
