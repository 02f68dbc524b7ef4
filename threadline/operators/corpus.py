"""The corpus: ordered rows of text in groups, and the tables that searches need of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from threadline.functions.text import ARABIC, Profile, evidence_stems, normalize, split_words, stems


class CorpusError(ValueError):
    """A corpus that can't be used."""


def prepare(rows: DataFrame, profile: Profile = ARABIC, expected_rows: int | None = None) -> DataFrame:
    """From group_id, ordinal, raw_text and clean_text: the rows with text (normalised), words, stems, evidence, and their
    group's first and last ordinal. Rows must be unique by (group_id, ordinal). With expected_rows, another count is an error."""
    if expected_rows is not None and (n := rows.count()) != expected_rows:
        raise CorpusError(f"{n} rows instead of {expected_rows}")
    out = rows.withColumn("text", normalize(F.col("clean_text"), profile)).withColumn("words", split_words(F.col("text")))
    group = Window.partitionBy("group_id")
    return out.withColumns(
        {
            "stems": stems(F.col("words"), profile),
            "evidence": evidence_stems(F.col("words"), profile),
            "first_ordinal": F.min("ordinal").over(group),
            "last_ordinal": F.max("ordinal").over(group),
        }
    )


def row(corpus: DataFrame, group_id: int, ordinal: int) -> DataFrame:
    return corpus.where((F.col("group_id") == group_id) & (F.col("ordinal") == ordinal))


def group(corpus: DataFrame, group_id: int) -> DataFrame:
    return corpus.where(F.col("group_id") == group_id).orderBy("ordinal")


def stem_index(corpus: DataFrame) -> DataFrame:
    """stem, group_id, ordinal: which rows have which evidence."""
    return corpus.select(F.explode("evidence").alias("stem"), "group_id", "ordinal")


def spans(corpus: DataFrame, lengths: tuple[int, ...] = (2, 3)) -> DataFrame:
    """Texts of consecutive rows: group_id, ordinal, ordinal_end, raw_text, text. Spans over a missing row are left out."""
    order = Window.partitionBy("group_id").orderBy("ordinal")
    out = None
    for k in lengths:
        frame = order.rowsBetween(0, k - 1)
        joined = corpus.select(
            "group_id",
            "ordinal",
            F.last("ordinal").over(frame).alias("ordinal_end"),
            F.array_join(F.collect_list("raw_text").over(frame), " ").alias("raw_text"),
            F.array_join(F.collect_list("text").over(frame), " ").alias("text"),
        ).where(F.col("ordinal_end") - F.col("ordinal") == k - 1)
        out = joined if out is None else out.unionByName(joined)
    return out


def end_flags(corpus: DataFrame) -> DataFrame:
    """group_id, ordinal, at_end (no next row) and near_end (no row after the next)."""
    return corpus.select("group_id", "ordinal", (F.col("ordinal") == F.col("last_ordinal")).alias("at_end"), (F.col("ordinal") + 2 > F.col("last_ordinal")).alias("near_end"))


def group_index(corpus: DataFrame) -> DataFrame:
    """group_id, its sorted ordinals, and the first and last of them."""
    return corpus.groupBy("group_id").agg(F.array_sort(F.collect_list("ordinal")).alias("ordinals"), F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"))


def neighbours(corpus: DataFrame) -> DataFrame:
    """corpus with the ordinals and texts of the rows before and after; null where there is none, or a row is missing between."""
    order, out = Window.partitionBy("group_id").orderBy("ordinal"), corpus
    for name, shift in (("previous", -1), ("next", 1)):
        at = F.lag("ordinal", -shift).over(order)
        close = at == F.col("ordinal") + shift
        out = out.withColumns({f"{name}_ordinal": F.when(close, at), f"{name}_text": F.when(close, F.lag("text", -shift).over(order))})
    return out
