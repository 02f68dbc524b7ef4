"""Approximate search of queries in a corpus: pruning, scoring, spans, ranking, thresholds and ambiguity.

Queries have query_id, text (normalised), words and evidence. Every step is a join or a window by query_id; a query's best row
is the one with the highest score, then the least group, ordinal and span.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from threadline.durable import durable, small_batches
from threadline.functions.scores import discovery_scores, fast_direct, fast_fragment, fast_scoped, span_scores
from threadline.functions.similarity import continuation_bonus
from threadline.functions.text import ARABIC, Profile, evidence_stems, normalize, split_words, stems
from threadline.operators.bounded import best_of_all, nearest_by_ratio
from threadline.operators.corpus import spans, stem_index
from threadline.operators.similar import similar_words

FIRST_THRESHOLD, LATER_THRESHOLD = 0.65, 0.45
SEEDS = 20
#: A corpus of more rows counts as wide: fragments of spans need no further signs, and similar stems are not looked for.
WIDE = 200


def queries(rows: DataFrame, profile: Profile = ARABIC) -> DataFrame:
    """From query_id and raw_text."""
    out = rows.withColumn("text", normalize(F.col("raw_text"), profile)).withColumn("words", split_words(F.col("text")))
    return out.withColumn("evidence", evidence_stems(F.col("words"), profile))


#: A stem in more rows than this, and than a PARTS-th of all entries of the index, is frequent; so at most PARTS stems are.
FREQUENT, PARTS = 10_000, 4096


def frequent_stems(counts: DataFrame, least: int = FREQUENT) -> DataFrame:
    """stem and _pieces, in how many pieces its rows are dealt, of the frequent stems. counts: stem and n, its rows."""
    most = max(least, (counts.agg(F.sum("n")).first()[0] or 0) // PARTS)
    return counts.where(F.col("n") > most).select("stem", F.ceil(F.col("n") / most).cast("int").alias("_pieces"))


def _dealt(index: DataFrame, frequent: DataFrame) -> DataFrame:
    """index with _piece: the rows of a frequent stem are dealt into pieces, all others are one."""
    pieces = F.coalesce("_pieces", F.lit(1))
    return index.join(F.broadcast(frequent), "stem", "left").withColumn("_piece", F.pmod(F.xxhash64("group_id", "ordinal"), pieces).cast("int")).drop("_pieces")


#: Stems of queries, with their queries, that a worker holds at most, and pairs that it counts at once.
HELD, COUNTED = 1_000_000, 1 << 21


def _counted(asked: DataFrame, corpus: DataFrame, least: int) -> DataFrame:
    """sharing_stems() for queries of at most HELD stems (query_id, stem), which every worker holds: a row's stems are all in one place, so they
    are counted there, and nothing moves but what is found."""
    small_batches(corpus.sparkSession)
    held = asked.toArrow()
    column = lambda name: pa.concat_arrays(held.column(name).chunks or [pa.array([], held.schema.field(name).type)]).dictionary_encode("encode")
    ids, stems_ = column("query_id"), column("stem")
    codes = stems_.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(codes, kind="stable")
    starts = np.searchsorted(codes[order], np.arange(len(stems_.dictionary) + 1))
    shared = corpus.sparkSession.sparkContext.broadcast((stems_.dictionary, starts, ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)[order], ids.dictionary))

    def run(batches):
        known, starts, of, names = shared.value
        for batch in batches:
            lists = batch.column(2)
            code, row = pc.index_in(lists.flatten(), value_set=known), pc.list_parent_indices(lists)
            heard = code.is_valid()
            code, row = (x.filter(heard).to_numpy(zero_copy_only=False).astype(np.int64) for x in (code, row))
            many = starts[code + 1] - starts[code]
            until = np.append(0, np.cumsum(many))
            a = 0
            while a < len(row):  # whole rows, about COUNTED pairs at once
                b = max(a + 1, int(np.searchsorted(until, until[a] + COUNTED, "right")) - 1)
                b = int(np.searchsorted(row, row[b], "left")) if b < len(row) and row[b] != row[a] else int(np.searchsorted(row, row[b - 1], "right"))
                n = many[a:b]
                at = np.arange(n.sum()) + np.repeat(starts[code[a:b]] - (np.cumsum(n) - n), n)
                pair, times = np.unique(np.repeat(row[a:b], n) * len(names) + of[at], return_counts=True)
                pair, times = pair[times >= least], times[times >= least]
                here = pa.array(pair // len(names))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(pair % len(names))), batch.column(0).take(here), batch.column(1).take(here), pa.array(times.astype(np.int64))], names=["query_id", "group_id", "ordinal", "shared"])
                a = b

    kinds = T.StructType([asked.schema["query_id"], corpus.schema["group_id"], corpus.schema["ordinal"], T.StructField("shared", T.LongType())])
    return corpus.select("group_id", "ordinal", F.array_distinct("evidence").alias("evidence")).mapInArrow(run, kinds)


def sharing_stems(queries_: DataFrame, corpus: DataFrame, least: int = 1, frequent: int = FREQUENT, held: int = HELD) -> DataFrame:
    """query_id, group_id, ordinal and shared, the number of stems in common, of rows that share `least` or more with the query.

    Queries of up to `held` stems in all are sent to the rows, see _counted(); more meet them by a shuffle, as follows.
    Of a query's n stems only the n - least + 1 rarest in the corpus are looked up: a row that has `least` of them has one of
    these. Rows of frequent stems are dealt into pieces, which a query that asks for the stem meets one by one, so that no task
    has a stem of all rows; as at most PARTS stems are frequent, they are broadcast. Queries of fewer stems than `least` find
    nothing; null evidence counts as none. Ids are unique in queries_ and in corpus.
    """
    few = queries_.where(F.size("evidence") >= least).select("query_id", F.explode(F.array_distinct("evidence")).alias("stem"))
    if few.limit(held + 1).count() <= held:
        return _counted(few, corpus, least)
    index = stem_index(corpus)
    counts = durable(index.groupBy("stem").agg(F.count("*").alias("n")))
    often = durable(frequent_stems(counts, frequent))
    asked = queries_.where(F.size("evidence") >= least).select("query_id", F.size("evidence").alias("_size"), F.explode("evidence").alias("stem"))
    if least > 1:
        rarest = Window.partitionBy("query_id").orderBy("n", "stem")
        asked = asked.join(counts, "stem", "left").withColumn("_rank", F.row_number().over(rarest)).where(F.col("_rank") <= F.col("_size") - least + 1)
    asked = asked.select("query_id", "stem").join(F.broadcast(often), "stem", "left")
    asked = asked.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_pieces")
    found = asked.join(_dealt(index, often), ["stem", "_piece"]).groupBy("query_id", "group_id", "ordinal").agg(F.count("*").alias("shared"))
    if least == 1:
        return found
    own = queries_.select("query_id", F.col("evidence").alias("_wanted"))
    both = found.drop("shared").join(own, "query_id").join(corpus.select("group_id", "ordinal", "evidence"), ["group_id", "ordinal"])
    both = both.select("query_id", "group_id", "ordinal", F.size(F.array_intersect("_wanted", "evidence")).cast("long").alias("shared"))
    return both.where(F.col("shared") >= least)


def sharing_a_stem(queries_: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, group_id, ordinal of rows that share evidence with the query."""
    return sharing_stems(queries_, corpus).drop("shared")


def similar_stems(queries_: DataFrame, corpus: DataFrame, profile: Profile = ARABIC, threshold: float = 0.72) -> DataFrame:
    """query_id, group_id, ordinal of rows with a stem, of a word of four letters or more, that is close to one of the query's. Only
    distinct stems are compared, see similar_words(); what rows and queries have of them is joined afterwards."""
    wanted = queries_.select("query_id", F.explode("evidence").alias("word"))
    rows = corpus.select("group_id", "ordinal", F.explode(F.array_distinct(stems(F.filter("words", lambda w: F.length(w) >= 4), profile))).alias("other"))
    close = durable(similar_words(wanted, rows.select(F.col("other").alias("word")), threshold).select("word", "other"))
    return wanted.join(close, "word").select("query_id", "other").distinct().join(rows, "other").select("query_id", "group_id", "ordinal").distinct()


def candidates(queries_: DataFrame, corpus: DataFrame, profile: Profile = ARABIC, similar_up_to: int | None = WIDE) -> DataFrame:
    """query_id, group_id, ordinal. Queries with two stems or more meet every row that shares one; those that find none meet, in a
    corpus of at most similar_up_to rows (None: of any size), the rows with a similar stem; who then has no row, and who has less
    evidence, meets all rows."""
    found = durable(sharing_a_stem(queries_.where("size(evidence) >= 2"), corpus))
    rest = queries_.join(found.select("query_id").distinct(), "query_id", "left_anti")
    if similar_up_to is None or corpus.select("group_id").limit(similar_up_to + 1).count() <= similar_up_to:
        similar = durable(similar_stems(rest.where("size(evidence) >= 2"), corpus, profile))
        found, rest = found.union(similar), rest.join(similar.select("query_id").distinct(), "query_id", "left_anti")
    return found.union(F.broadcast(rest.select("query_id")).crossJoin(corpus.select("group_id", "ordinal")))


def _is_wide(corpus: DataFrame) -> bool:
    return corpus.select("group_id").limit(WIDE + 1).count() > WIDE


def _asking(queries_: DataFrame, corpus: DataFrame) -> DataFrame:
    """The queries with `every`, whether they meet all rows of a wide corpus: those with fewer than two stems, or none that a row has."""
    asked = queries_.where("size(evidence) >= 2").select("query_id", F.explode("evidence").alias("stem"))
    heard = asked.join(stem_index(corpus).select("stem").distinct(), "stem", "left_semi").select("query_id").distinct().withColumn("_heard", F.lit(True))
    return queries_.join(heard, "query_id", "left").withColumn("every", F.col("_heard").isNull())


def nearest(queries_: DataFrame, corpus: DataFrame, digits: int = 9, n: int = 1, profile: Profile = ARABIC) -> DataFrame:
    """The n candidates with the highest ratio of each query: query_id, group_id, ordinal, score (rounded), rank; of equals the
    first. Candidates are compared unless a bound says that they can't be among these."""
    if _is_wide(corpus):
        return best_of_all(_asking(queries_, corpus), corpus, n, digits)
    return nearest_by_ratio(candidates(queries_, corpus, profile), queries_, corpus, n, digits)


def _ranked(scored: DataFrame, n: int = 1) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "group_id", "ordinal", F.asc_nulls_first("ordinal_end"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def spread(pairs: DataFrame) -> DataFrame:
    """The pairs dealt to as many tasks as the session asks for, whatever their bytes: they are few in bytes and dear in work, and without
    a number they would be put together into a few tasks."""
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *[c for c in ("query_id", "group_id", "ordinal") if c in pairs.columns])


def _paired(pairs: DataFrame, queries_: DataFrame, corpus: DataFrame) -> DataFrame:
    """The pairs with text and row_text, spread over tasks whatever their queries."""
    small_batches(pairs.sparkSession)
    rows = corpus.select("group_id", "ordinal", F.col("text").alias("row_text"))
    both = pairs.join(queries_.select("query_id", "text"), "query_id").join(rows, ["group_id", "ordinal"])
    return spread(both)


def top(queries_: DataFrame, corpus: DataFrame, n: int = SEEDS, profile: Profile = ARABIC) -> DataFrame:
    """The n best single rows of each query: query_id, group_id, ordinal, ordinal_end (null), score, rank."""
    if _is_wide(corpus):
        found = best_of_all(_asking(queries_, corpus), corpus, n, profile=profile)
        return found.select("query_id", "group_id", "ordinal", F.lit(None).cast("int").alias("ordinal_end"), "score", "rank")
    both = _paired(candidates(queries_, corpus, profile), queries_, corpus)
    score = discovery_scores(profile)("text", "row_text")
    return _ranked(both.select("query_id", "group_id", "ordinal", F.lit(None).cast("int").alias("ordinal_end"), score.alias("score")), n)


def span_starts(seeds: DataFrame, corpus: DataFrame, back: int = 2) -> DataFrame:
    """Rows up to `back` before each seed, that exist, once each."""
    starts = seeds.select("query_id", "group_id", F.explode(F.sequence(F.col("ordinal") - back, F.col("ordinal"))).alias("ordinal"))
    return starts.join(corpus.select("group_id", "ordinal"), ["group_id", "ordinal"], "left_semi").select("query_id", "group_id", "ordinal").distinct()


def match(queries_: DataFrame, corpus: DataFrame, threshold: float = FIRST_THRESHOLD, widen_below: float = 0.72, profile: Profile = ARABIC) -> DataFrame:
    """One row or span for each query that reaches the threshold: query_id, group_id, ordinal, ordinal_end (null for one row), score.

    Single rows come first; for queries whose best is below widen_below, spans of two and three rows around the 20 best rows are
    scored too; in a wide corpus, queries of three words that are still below the threshold also meet the spans at all groups'
    openings. Spans win only with a higher score. Empty queries match nothing.
    """
    queries_ = durable(queries_.where("text <> ''"))
    singles = durable(top(queries_, corpus, SEEDS, profile))
    best = singles.where("rank = 1").drop("rank")
    wide = _is_wide(corpus)
    texts = spans(corpus).select("group_id", "ordinal", "ordinal_end", F.col("text").alias("row_text"))
    weak = best.where(F.col("score") < widen_below).select("query_id")

    def scored(starts: DataFrame, always: bool) -> DataFrame:
        both = spread(starts.join(texts, ["group_id", "ordinal"]).join(queries_.select("query_id", "text"), "query_id"))
        return both.select("query_id", "group_id", "ordinal", "ordinal_end", span_scores(profile)("text", "row_text", F.lit(always)).alias("score"))

    best = durable(_ranked(best.unionByName(scored(span_starts(singles.join(weak, "query_id", "left_semi"), corpus), wide))).drop("rank"))
    if wide:
        low = best.where(F.col("score") < threshold).join(queries_.where("size(words) >= 3"), "query_id", "left_semi").select("query_id")
        openings = F.broadcast(low).crossJoin(corpus.where("ordinal = first_ordinal").select("group_id", "ordinal"))
        best = _ranked(best.unionByName(scored(openings, True))).drop("rank")
    return best.where(F.col("score") >= threshold)


def match_in_group(queries_: DataFrame, corpus: DataFrame, hint: str = "hint", low: str | None = None, high: str | None = None) -> DataFrame:
    """The best row in each query's hinted group, within bounds on the ordinal if their columns are named."""
    joined = queries_.join(corpus.select("group_id", "ordinal", F.col("text").alias("row_text")), F.col(hint) == F.col("group_id"))
    if low:
        joined = joined.where(F.col("ordinal") >= F.coalesce(F.col(low), F.col("ordinal")))
    if high:
        joined = joined.where(F.col("ordinal") <= F.coalesce(F.col(high), F.col("ordinal")))
    small_batches(queries_.sparkSession)
    joined = spread(joined)
    scored = joined.select("query_id", "group_id", "ordinal", F.lit(None).cast("int").alias("ordinal_end"), fast_direct("text", "row_text").alias("score"))
    return _ranked(scored).drop("rank")


def hint_or_global(hinted: DataFrame, anywhere: DataFrame, threshold: float = FIRST_THRESHOLD) -> DataFrame:
    """The hinted result where it reaches the threshold, else the global one."""
    good = hinted.where(F.col("score") >= threshold)
    return good.unionByName(anywhere.join(good.select("query_id"), "query_id", "left_anti"))


def scoped(positions: DataFrame, corpus: DataFrame, reach: int = 3) -> DataFrame:
    """Rows near each query's position: query_id, group_id, ordinal, score. positions: query_id, text, current_group, current_ordinal.

    The same group within `reach` rows, and the next group's first row where the position is its group's last.
    """
    ends = corpus.select(F.col("group_id").alias("current_group"), "last_ordinal").distinct()
    here = positions.join(ends, "current_group").withColumn("is_last", F.col("current_ordinal") == F.col("last_ordinal")).drop("last_ordinal")
    rows = corpus.select("group_id", "ordinal", "first_ordinal", F.col("text").alias("row_text"))
    near = here.withColumn("ordinal", F.explode(F.sequence(F.col("current_ordinal") - reach, F.col("current_ordinal") + reach)))
    near = near.join(rows, (F.col("current_group") == rows["group_id"]) & (near["ordinal"] == rows["ordinal"])).drop(near["ordinal"])
    turn = here.where("is_last").join(rows.where("ordinal = first_ordinal"), F.col("current_group") + 1 == F.col("group_id"))
    both = near.select(*turn.columns).unionByName(turn)
    bonus = continuation_bonus(F.col("group_id"), F.col("ordinal"), F.col("current_group"), F.col("current_ordinal"), F.col("is_last"), 1)
    small_batches(corpus.sparkSession)
    both = spread(both.withColumn("_bonus", bonus))
    return both.select("query_id", "group_id", "ordinal", F.least(F.lit(1.0), fast_scoped("text", "row_text") + F.col("_bonus")).alias("score"))


def ambiguous(best: DataFrame, scored: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """The results of single rows that another row comes within `tolerance` of."""
    other = scored.select(F.col("query_id").alias("q"), F.col("group_id").alias("g"), F.col("ordinal").alias("o"), F.col("score").alias("s"))
    close = (F.col("query_id") == F.col("q")) & ((F.col("group_id") != F.col("g")) | (F.col("ordinal") != F.col("o"))) & (F.col("s") >= F.col("score") - tolerance)
    return best.where("ordinal_end is null").join(other, close, "left_semi")


def unrivalled(local: DataFrame, anywhere: DataFrame, margin: float = 0.08) -> DataFrame:
    """Local results without a global best in another group that is better by the margin."""
    other = anywhere.select(F.col("query_id").alias("q"), F.col("group_id").alias("g"), F.col("score").alias("s"))
    return local.join(other, (F.col("query_id") == F.col("q")) & (F.col("group_id") != F.col("g")) & (F.col("s") >= F.col("score") + margin), "left_anti")


def contained(results: DataFrame, queries_: DataFrame, corpus: DataFrame) -> DataFrame:
    """For spans, the row in them that fits best, with the better of its and the span's score; the earliest of equal rows."""
    small_batches(corpus.sparkSession)
    wide = results.where("ordinal_end is not null").select("query_id", "group_id", F.col("score").alias("span_score"), F.explode(F.sequence("ordinal", "ordinal_end")).alias("ordinal"))
    both = wide.join(queries_.select("query_id", "text"), "query_id").join(corpus.select("group_id", "ordinal", F.col("text").alias("row_text")), ["group_id", "ordinal"])
    ranked = _ranked(spread(both).select("query_id", "group_id", "ordinal", F.lit(None).cast("int").alias("ordinal_end"), "span_score", fast_fragment("text", "row_text").alias("score")))
    return ranked.select("query_id", "group_id", "ordinal", F.greatest("score", "span_score").alias("score"))
