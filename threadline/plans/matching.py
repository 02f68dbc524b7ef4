"""Scores, evidence, lookups, search steps, signals and sessions as queries over the standard tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from threadline.durable import durable, small_batches
from threadline.functions import graphemes, signal, similarity, text
from threadline.functions.scores import fast_ratio, fast_scores
from threadline.operators import corpus as corpora, fragments, search, similar
from threadline.plans.queries import CANDIDATES, CORPUS, EVIDENCE, FLAT, NORM, P, STEM, STOP, _corpus, _queries, _t
from threadline.streaming import rounds, sinks, windows

# Rows and what follows them


def _pairs(spark, d, *of: str) -> DataFrame:
    """Each row with the next one of its group: the columns named, and as next_ those of the next row (and next_text)."""
    order = Window.partitionBy("group_id").orderBy("ordinal")
    rows = _corpus(spark, d).select("group_id", "ordinal", "last_ordinal", *of)
    for c in of:
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(order))
    small_batches(spark)
    return search.spread(rows.where("next_text is not null"))


def similarity_scores(spark, d):
    p, r = _pairs(spark, d, "text"), lambda c: F.round(c, 6)
    bonus = similarity.continuation_bonus(F.col("group_id"), F.col("ordinal") + 1, F.col("group_id"), F.col("ordinal"), F.col("ordinal") == F.col("last_ordinal"))
    p = p.select("group_id", "ordinal", bonus.alias("bonus"), fast_scores("text", "next_text").alias("s"))
    scoped = F.least(F.lit(1.0), F.col("s.scoped") + F.col("bonus"))
    return p.select(
        "group_id",
        "ordinal",
        "s.distance",
        r(F.col("s.fragment")).alias("fragment"),
        r(F.col("s.direct")).alias("direct"),
        r(F.col("bonus")).alias("bonus"),
        r(scoped).alias("scoped"),
        r(similarity.clamp(scoped * 2 - 0.5)).alias("confidence"),
        similarity.moves_on(F.col("s.ratio"), F.lit(0.15)).alias("moves_on"),
    )


def stem_evidence(spark, d):
    p = _pairs(spark, d, "text", "words", "stems")
    q, t = F.col("stems"), F.col("next_stems")
    best = similarity.best_stem_score(F.element_at(t, 1), q)
    return p.where("size(next_stems) > 0").select(
        "group_id",
        "ordinal",
        F.round(best, 6).alias("best_first"),
        similarity.distinctive_hits(q, t).cast("long").alias("distinctive"),
        similarity.distinctive_hits(q, t, generic=P.generic).cast("long").alias("telling"),
        similarity.has_strong_pair(q, t).alias("strong_pair"),
        similarity.has_distinct_target_word(F.col("next_words"), F.slice("next_words", 1, 3), F.col("words")).alias("distinct_word"),
        F.round(F.coalesce(similarity.ending_confidence(q, t), F.lit(0.0)), 6).alias("ending"),
        F.round(F.coalesce(similarity.tail_confidence(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(1))), t), F.lit(0.0)), 6).alias("tail"),
    )


def evidence_hits(spark, d):
    p = _pairs(spark, d, "text", "words", "evidence")
    q, wanted = F.col("evidence"), text.stems(F.filter("next_words", lambda w: F.length(w) >= 4), P)
    p = p.select("group_id", "ordinal", F.size("words").alias("n"), F.size(q).alias("known"), similarity.evidence_hits(q, wanted).alias("hits"), fast_ratio("text", "next_text").alias("base"))
    three, hits, base = F.col("n") >= 3, F.col("hits"), F.col("base")
    return p.select(
        "group_id",
        "ordinal",
        hits.cast("long").alias("hits"),
        (hits > 0).alias("has_evidence"),
        (three & ((base >= 0.34) | ((F.col("known") >= 2) & (hits > 0)))).alias("as_fragment"),
        (three & ((base >= 0.45) | (hits >= 2))).alias("as_entry_fragment"),
    )


def word_alignment(spark, d):
    p = _pairs(spark, d, "text", "words").withColumn("a", similarity.word_alignment(F.col("words"), F.col("next_words")))
    return p.select("group_id", "ordinal", F.col("a.matched").cast("long").alias("matched"), F.col("a.total").cast("long").alias("total"), similarity.is_covered(F.col("a"), 0.2).alias("covered"))


def phrase_predicates(spark, d):
    c = _corpus(spark, d)
    first = F.slice("words", 1, 2)
    return c.select(
        "group_id",
        "ordinal",
        text.is_generic(first, P).alias("generic_start"),
        text.is_opening_phrase(F.col("words"), P).alias("opens"),
        text.is_near_opening_phrase(F.col("words"), P).alias("nearly_opens"),
        F.array_join(F.slice("words", 1, 3), " ").alias("head"),
        F.array_join(F.slice("words", F.greatest(F.size("words") - 3, F.lit(1)), F.lit(4)), " ").alias("tail"),
    )


# Lookups


def key_lookup(spark, d):
    return corpora.row(_corpus(spark, d), 1, 0).select("group_id", "ordinal", "text")


def row_count(spark, d):
    return _corpus(spark, d).agg(F.count("*").alias("n_rows"))


def group_index(spark, d):
    return corpora.group_index(_corpus(spark, d)).select("group_id", F.array_join(F.transform("ordinals", lambda o: o.cast("string")), " ").alias("ordinals"), "first_ordinal", "last_ordinal")


def neighbours(spark, d):
    return corpora.neighbours(_corpus(spark, d)).select("group_id", "ordinal", F.coalesce("previous_ordinal", F.lit(-1)).alias("previous_ordinal"), F.coalesce("next_ordinal", F.lit(-1)).alias("next_ordinal"), F.sha2(F.coalesce("previous_text", F.lit("")).cast("binary"), 256).alias("previous"), F.sha2(F.coalesce("next_text", F.lit("")).cast("binary"), 256).alias("next"))


def span_backtrack(spark, d):
    c = _corpus(spark, d)
    seeds = c.where("ordinal = last_ordinal").select(F.lit(0).alias("query_id"), "group_id", "ordinal")
    return search.span_starts(seeds, c).select("group_id", "ordinal")


# Search


def _hinted(spark, d, shift: int) -> DataFrame:
    """Each row as a query for the rows of another group, or for those that follow it in its own."""
    q = _corpus(spark, d).select(F.concat_ws("/", "group_id", "ordinal").alias("query_id"), "text", (F.col("group_id") + shift).alias("hint"), (F.col("ordinal") + 1).alias("low"), (F.col("ordinal") + 3).alias("high"))
    return q if shift == 0 else q.drop("low", "high")


def group_match(spark, d):
    found = search.match_in_group(_hinted(spark, d, 0), _corpus(spark, d), low="low", high="high")
    return found.where("score >= 0.2").select("query_id", "group_id", "ordinal", F.round("score", 6).alias("score"))


def hint_fallback(spark, d):
    c = _corpus(spark, d)
    own = durable(search.match_in_group(_hinted(spark, d, 0), c, low="low", high="high"))
    found = own.where("score >= 0.25").select("query_id")
    other = search.match_in_group(_hinted(spark, d, 1).join(found, "query_id", "left_anti"), c)
    return search.hint_or_global(own, other, 0.25).select("query_id", "group_id", "ordinal", F.round("score", 6).alias("score"))


def stem_overlap(spark, d):
    """The turns that share three stems or more with a benchmark item."""
    return search.sharing_stems(_queries(spark, d), _corpus(spark, d), 3)


def fuzzy_theta_join(spark, d):
    """The turns with a stem that is close to one of a benchmark item's."""
    return search.similar_stems(_queries(spark, d), _corpus(spark, d), P)


def similar_stem_pairs(spark, d):
    """Stems of the benchmark and stems of the documents that are close to each other."""
    own = lambda t: _t(spark, d, t).select(F.explode(text.evidence_stems(text.words(F.col("text"), P), P)).alias("word"))
    found = similar.similar_words(own("benchmark"), own("documents"))
    return found.select("word", "other", F.round("ratio", 6).alias("ratio"))


def fragment_places(spark, d):
    """Which documents have a benchmark item in them, with a tenth of its letters wrong at most, and where."""
    items = _t(spark, d, "benchmark").select(F.col("item_id").alias("needle_id"), text.normalize(F.col("text"), P).alias("text"))
    docs = _t(spark, d, "documents").select("doc_id", text.normalize(F.col("text"), P).alias("text"))
    found = fragments.find_fragments(items, docs, 0.9, "doc_id")
    return found.select("needle_id", "doc_id", F.round("ratio", 6).alias("ratio"), "start")


def scoped_scores(spark, d):
    """Each turn as what is heard at its own place: the scores of what is near it, the next group's first turn included. Turns count from 1."""
    rows = _t(spark, d, "conversations").select(F.col("conv_id").alias("group_id"), (F.col("turn") + 1).cast("int").alias("ordinal"), F.col("text").alias("raw_text"), F.col("text").alias("clean_text"))
    c = corpora.prepare(rows, P)
    here = c.select(F.concat_ws("/", "group_id", "ordinal").alias("query_id"), "text", F.col("group_id").alias("current_group"), F.col("ordinal").alias("current_ordinal"))
    return search.scoped(here, c).select("query_id", "group_id", "ordinal", F.round("score", 6).alias("score"))


def grapheme_scores(spark, d):
    """Each row against the next one, every e with an accent of its own, which is no letter more."""
    accented = lambda c: F.regexp_replace(c, "e", "e\u0301")
    q, t = accented(F.col("text")), accented(F.col("next_text"))
    both = _pairs(spark, d, "text").select("group_id", "ordinal", F.length(q).alias("n_points"), graphemes.clusters(q).alias("x"), graphemes.clusters(t).alias("y"))
    both = both.select("group_id", "ordinal", "n_points", F.size("x").alias("n_clusters"), F.greatest(F.size("x"), F.size("y")).alias("longer"), graphemes.fast_distance("x", "y").alias("distance"))
    ratio = F.when(F.col("longer") == 0, F.lit(1.0)).otherwise(1 - F.col("distance") / F.col("longer"))
    return both.select("group_id", "ordinal", "n_points", "n_clusters", "distance", F.round(ratio, 6).alias("ratio"))


def sliding_looks(spark, d):
    """Events as chunks of one sample, an hour of them for a second of sound."""
    e = _t(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("ts").alias("at"), F.array("value").alias("samples"))
    of = (windows.Look("discovery", 12600.0, 720.0, 3, 1), windows.Look("tracking", 8100.0, 720.0, 2, 1))
    seen = windows.looks(e, of, quiet_rms=20.0, quiet_peak=40.0)
    return seen.select("session_id", "mode", F.col("end").cast("string").alias("ends"), "chunks", "samples", "fresh", F.round("rms", 6).alias("rms"), F.round("peak", 6).alias("peak"), "status")


def top_seeds(spark, d):
    found = search.nearest(_queries(spark, d), _corpus(spark, d), n=search.SEEDS, profile=P)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "group_id", "ordinal", "score")


def match_items(spark, d):
    """The row or span of the conversations that each benchmark item fits best, if it reaches 0.33."""
    found = search.match(_queries(spark, d), _corpus(spark, d), 0.33, profile=P)
    return found.select("query_id", "group_id", "ordinal", "ordinal_end", F.round("score", 6).alias("score"))


def _named(spark, d) -> DataFrame:
    """Nations against each other: query_id, group_id (the region), ordinal (the nation), score."""
    n = _t(spark, d, "nation")
    x, y = n.select(F.col("n_nationkey").alias("query_id"), F.col("n_name").alias("x")), n.select(F.col("n_regionkey").cast("int").alias("group_id"), F.col("n_nationkey").cast("int").alias("ordinal"), F.col("n_name").alias("y"))
    both = x.join(y, F.col("query_id") != F.col("ordinal"))
    return both.select("query_id", "group_id", "ordinal", F.lit(None).cast("int").alias("ordinal_end"), F.round(similarity.ratio(F.col("x"), F.col("y")), 6).alias("score"))


def _best_named(spark, d) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "group_id", "ordinal")
    return _named(spark, d).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def ambiguous_rows(spark, d):
    return search.ambiguous(_best_named(spark, d), _named(spark, d), 0.05).select("query_id", "group_id", "ordinal", "score")


def unrivalled_rows(spark, d):
    local = _named(spark, d).where("ordinal = query_id - 1")
    return search.unrivalled(local, _best_named(spark, d), 0.2).select("query_id", "group_id", "ordinal", "score")


def contained_best(spark, d):
    """For each span of three rows, which of them the first words of its middle row fit best."""
    c = _corpus(spark, d)
    s = corpora.spans(c, (3,)).select(F.concat_ws("/", "group_id", "ordinal").alias("query_id"), "group_id", "ordinal", "ordinal_end", F.lit(0.0).alias("score"))
    q = s.join(c.select("group_id", (F.col("ordinal") - 1).alias("ordinal"), "words"), ["group_id", "ordinal"]).select("query_id", F.array_join(F.slice("words", 1, 5), " ").alias("text"))
    return search.contained(s, q, c).select("query_id", "group_id", "ordinal", F.round("score", 6).alias("score"))


# Signals


def speech_gate(spark, d):
    q = signal.quality(F.col("embedding"), sample_rate=64, min_rms=0.05, min_peak=0.1, min_frame_ratio=0.4)
    e = _t(spark, d, "embeddings").select("vec_id", q.alias("q"))
    return e.where("q.is_speech").select("vec_id", F.round("q.frame_ratio", 6).alias("frame_ratio"), F.round("q.seconds", 6).alias("seconds"))


def znorm(spark, d):
    z = signal.znorm(F.transform("embedding", lambda x: x.cast("double")))
    e = _t(spark, d, "embeddings").select("vec_id", F.posexplode(z).alias("i", "z"))
    return e.groupBy("vec_id").agg(F.round(F.sum(F.col("z") * (F.col("i") + 1)), 4).alias("weighed"), F.round(F.sum(F.col("z") * F.col("z")), 4).alias("squares"))


def rolling_windows(spark, d):
    """Of each event, what a buffer of six hours and windows of 3.5 and 2.25 hours of its user hold; the newest three values."""
    e = _t(spark, d, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")))
    back = lambda hours: Window.partitionBy("user_id").orderBy("s").rangeBetween(-int(hours * 3_600_000_000), 0)
    kept = F.collect_list("value").over(Window.partitionBy("user_id").orderBy("s", "event_id").rowsBetween(-31, 0))
    return e.select(
        "event_id",
        F.count("*").over(back(6)).alias("buffered"),
        F.round(F.sum("value").over(back(3.5)), 2).alias("discovery"),
        F.round(F.sum("value").over(back(2.25)), 2).alias("tracking"),
        F.round(F.aggregate(signal.newest(kept, 3), F.lit(0.0), lambda a, x: a + x), 2).alias("newest"),
    )


# Sessions


def _shown(spark, d) -> DataFrame:
    reason = F.when(F.col("event_type") == "error", "lost").when(F.col("event_type") == "signup", "recovered").otherwise("followed")
    e = _t(spark, d, "events").select(F.col("user_id").alias("session_id"), (F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id") / 1e6).alias("ts"), reason.alias("reason"), "event_id")
    group = F.when(F.col("reason") != "lost", (F.col("event_id") % 3).cast("int"))
    return e.select("session_id", "ts", "reason", group.alias("group_id"), (F.col("event_id") % 11).cast("int").alias("ordinal"))


def replay_metrics(spark, d):
    m = sinks.replay_metrics(_shown(spark, d))
    return m.select("session_id", "returns", "groups", "regressions", "leaps", "last_group", "reach")


def latency(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("value").alias("inference_seconds"))
    return sinks.latency(e).select("session_id", "windows", F.round("mean_seconds", 4).alias("mean_seconds"), "longest_seconds")


def newest_events(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"))
    return sinks.newest(e).select("session_id", "seq")


def expected_rows(spark, d):
    c = _t(spark, d, "conversations")
    last = lambda rows: rows.groupBy(F.col("conv_id").alias("session_id")).agg(F.max("conv_id").alias("group_id"), F.max("turn").alias("ordinal"))
    return sinks.compared(last(c.where("role = 'user'")), last(c)).select("session_id", "expected_ordinal", F.col("ordinal").alias("predicted_ordinal"), "matched")


def tracker_replay(spark, d):
    """Each conversation as a session that reads its own turns, with the tracker over all of them."""
    c = _corpus(spark, d)
    windows = c.select(F.col("group_id").cast("string").alias("session_id"), F.col("ordinal").cast("double").alias("ts"), F.col("text").alias("discovery_text"), F.col("text").alias("tracking_text"), F.col("group_id").cast("int").alias("hint"))
    return rounds.replay_over(windows, c, P)


L = FLAT.format
RATIO = "CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE 1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END"
FLAT_WORDS = f"list_filter(string_split({L(x=NORM)}, ' '), lambda w: w <> '')"
FLAT_ROWS = f"f AS (SELECT conv_id AS group_id, CAST(turn AS INTEGER) AS ordinal, text AS raw, {L(x=NORM)} AS text, {FLAT_WORDS} AS words FROM conversations)"
STEMMED = f"list_filter(list_transform(words, lambda w: {STEM}), lambda s: length(s) >= 3)"
LONG = f"list_filter(list_transform(list_filter(words, lambda w: length(w) >= 4), lambda w: {STEM}), lambda s: length(s) >= 3)"
#: Sorted before letters are mapped, as the first of close stems by name counts.
KEPT = f"list_transform(list_sort(list_filter({EVIDENCE.replace('text', 'raw')}, lambda s: true)), lambda s: {L(x='s')})"
PAIRS = f"{FLAT_ROWS}, g AS (SELECT *, max(ordinal) OVER (PARTITION BY group_id) AS top, {STEMMED} AS stems, {LONG} AS longs, {KEPT} AS evidence FROM f), p AS (SELECT a.*, b.text AS nt, b.words AS nw, b.stems AS ns, b.longs AS nl FROM g a JOIN g b ON a.group_id = b.group_id AND b.ordinal = a.ordinal + 1)"
WORDS_OF = "len(list_filter(string_split({x}, ' '), lambda w: w <> ''))"


def _fragment(q: str, t: str) -> str:
    """SQL of the fragment score of columns q and t, whose ratio is the column full."""
    m, n = f"least(length({q}), length({t}))", f"greatest(length({q}), length({t}))"
    short, long = f"CASE WHEN length({q}) <= length({t}) THEN {q} ELSE {t} END", f"CASE WHEN length({q}) <= length({t}) THEN {t} ELSE {q} END"
    partial = f"list_max(list_transform(range(1, {n} - {m} + 2), lambda i: 1 - levenshtein({short}, substr({long}, i, {m}))::DOUBLE / {m}))"
    nq, nt = WORDS_OF.format(x=q), WORDS_OF.format(x=t)
    blend = f"CASE WHEN {partial} <= full_ THEN full_ ELSE greatest(full_, 0.25::DOUBLE * full_ + 0.75::DOUBLE * {partial} * least(1.0::DOUBLE, {nt}::DOUBLE / {nq})) END"
    return f"CASE WHEN {nq} < 2 OR {nt} < 2 THEN 0::DOUBLE WHEN {m} > 100 THEN full_ ELSE {blend} END"


def _direct(q: str, t: str) -> str:
    """SQL of the direct score, with columns full_ and fragment_."""
    n = f"length({q})"
    wide = f"{WORDS_OF.format(x=q)} >= 2 AND (({n} >= 8 AND (full_ > 0.15 OR length({t}) > 3 * {n})) OR ({n} >= 6 AND {n} < 8 AND full_ > 0.15))"
    return f"CASE WHEN length({q}) * length({t}) = 0 THEN 0::DOUBLE WHEN {wide} THEN greatest(full_, fragment_) ELSE full_ END"


def _scored(rows: str, q: str, t: str) -> str:
    """SQL: a query's rows with full_, fragment_ and direct_."""
    return f"SELECT *, {_direct(q, t)} AS direct_ FROM (SELECT *, {_fragment(q, t)} AS fragment_ FROM (SELECT *, {RATIO.format(a=q, b=t)} AS full_ FROM ({rows})))"


NEAR = "1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) >= {t}"
BEST = "coalesce(list_max(list_transform(stems, lambda x: 1 - levenshtein(x, {r})::DOUBLE / greatest(length(x), length({r})))), 0)"
BEST_IN = "coalesce(list_max(list_transform(ns[1:greatest(len(ns) - 1, 1)], lambda x: 1 - levenshtein(x, {r})::DOUBLE / greatest(length(x), length({r})))), 0)"
HITS = "len(list_filter(list_distinct({q}), lambda x: len(list_filter({r}, lambda y: " + NEAR.format(a="x", b="y", t="0.78") + ")) > 0))"
GENERIC = ", ".join(f"'{w}'" for w in P.generic)
OPENING = ", ".join(f"'{w}'" for w in P.opening)


HAS = "len(list_filter({l}, lambda w: w IN ({x}))) > 0"
NEARLY = f"len(list_filter(list_transform(list_transform(words, lambda w: {STEM}), lambda s: {L(x='s')}), lambda s: 1 - levenshtein(s, '{{x}}')::DOUBLE / greatest(length(s), 5) >= 0.78)) > 0"


def _tail(best: str) -> str:
    scores = f"list_transform(ns[greatest(len(ns) - 3, 1):], lambda r: {best.format(r='r')})"
    return (
        f"CASE WHEN len(ns) >= 5 AND {best.format(r='ns[len(ns) - 1]')} >= 0.82 AND len(list_filter({scores}, lambda s: s >= 0.76)) >= 2 "
        f"THEN least(greatest(0.65::DOUBLE * {best.format(r='ns[len(ns) - 1]')} + 0.20::DOUBLE * list_avg(list_filter({scores}, lambda s: s >= 0.76)), 0.72), 0.90) ELSE 0 END"
    )


LAST, PENULTIMATE = BEST.format(r="ns[len(ns)]"), "CASE WHEN len(ns) >= 2 THEN " + BEST.format(r="ns[len(ns) - 1]") + " ELSE 0 END"
HINTED = f"{FLAT_ROWS}, own AS (" + _scored("SELECT a.group_id || '/' || a.ordinal AS query_id, b.group_id, b.ordinal, a.text AS q, b.text AS t FROM f a JOIN f b ON a.group_id = b.group_id AND b.ordinal BETWEEN a.ordinal + 1 AND a.ordinal + 3", "q", "t") + "), best AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY direct_ DESC, group_id, ordinal) = 1)"
NAMED = "named AS (SELECT x.n_nationkey AS query_id, CAST(y.n_regionkey AS INTEGER) AS group_id, CAST(y.n_nationkey AS INTEGER) AS ordinal, round(1 - levenshtein(x.n_name, y.n_name)::DOUBLE / greatest(length(x.n_name), length(y.n_name)), 6) AS score FROM nation x JOIN nation y ON x.n_nationkey <> y.n_nationkey), best AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, group_id, ordinal) = 1)"

WIDE_CORPUS = f"(SELECT count(*) FROM c) > {search.WIDE}"
#: Single rows, then spans around the best of weak queries, then spans at openings. A query's evidence is used up row stem by row stem.
MATCHED = f"""{CANDIDATES},
a AS (SELECT query_id, q.text AS q, {WORDS_OF.format(x='q.text')} AS nw, list_transform(list_sort(list_filter(evidence, lambda s: true)), lambda s: {L(x='s')}) AS kept FROM q WHERE q.text <> ''),
b AS (SELECT group_id, ordinal, text AS t, list_transform({LONG}, lambda s: {L(x='s')}) AS longs FROM (SELECT group_id, ordinal, {L(x='text')} AS text, words FROM c)),
s0 AS (SELECT query_id, group_id, ordinal, q, nw, kept, t, longs, {RATIO.format(a='q', b='t')} AS full_ FROM m JOIN a USING (query_id) JOIN b USING (group_id, ordinal)),
s1 AS MATERIALIZED (SELECT *, {_fragment('q', 't')} AS fragment_ FROM s0),
need AS (SELECT * FROM s1 WHERE fragment_ > full_ AND full_ > 0.25 AND full_ < 0.45 AND length(q) >= 20 AND nw >= 3),
u AS (SELECT query_id, group_id, ordinal, 0 AS k, kept AS rest FROM need
  UNION ALL SELECT u.query_id, u.group_id, u.ordinal, k + 1, CASE WHEN list_contains(rest, longs[k + 1]) THEN list_filter(rest, lambda x: x <> longs[k + 1])
    ELSE list_filter(rest, lambda x: x <> coalesce(list_filter(rest, lambda y: {NEAR.format(a='y', b='longs[k + 1]', t='0.72')})[1], '')) END
  FROM u JOIN need USING (query_id, group_id, ordinal) WHERE k < len(longs)),
used AS (SELECT query_id, group_id, ordinal, len(kept) - len(rest) AS hits FROM u JOIN need USING (query_id, group_id, ordinal) WHERE k = len(longs)),
singles AS MATERIALIZED (SELECT s1.query_id, s1.group_id, s1.ordinal, NULL::INTEGER AS ordinal_end,
    CASE WHEN full_ > 0.25 AND length(q) >= 20 AND nw >= 3 AND (full_ >= 0.45 OR hits >= 2) THEN greatest(full_, fragment_) ELSE full_ END AS score
  FROM s1 LEFT JOIN used USING (query_id, group_id, ordinal)),
seeds AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, group_id, ordinal) AS rank FROM singles QUALIFY rank <= 20),
one AS (SELECT * EXCLUDE rank FROM seeds WHERE rank = 1),
sp AS (SELECT x.group_id, x.ordinal, y.ordinal AS ordinal_end, x.t || ' ' || y.t AS t, list_concat(x.longs, y.longs) AS longs FROM b x JOIN b y ON x.group_id = y.group_id AND y.ordinal = x.ordinal + 1
  UNION ALL SELECT x.group_id, x.ordinal, z.ordinal, x.t || ' ' || y.t || ' ' || z.t, list_concat(x.longs, y.longs, z.longs) FROM b x JOIN b y ON x.group_id = y.group_id AND y.ordinal = x.ordinal + 1 JOIN b z ON x.group_id = z.group_id AND z.ordinal = x.ordinal + 2),
st AS (SELECT DISTINCT query_id, seeds.group_id, b.ordinal FROM seeds JOIN b ON seeds.group_id = b.group_id AND b.ordinal BETWEEN seeds.ordinal - 2 AND seeds.ordinal WHERE query_id IN (SELECT query_id FROM one WHERE score < 0.72)),
w0 AS (SELECT query_id, group_id, ordinal, ordinal_end, q, nw, kept, t, longs, {RATIO.format(a='q', b='t')} AS full_ FROM st JOIN sp USING (group_id, ordinal) JOIN a USING (query_id)),
w1 AS MATERIALIZED (SELECT *, {_fragment('q', 't')} AS fragment_ FROM w0),
near_spans AS (SELECT query_id, group_id, ordinal, ordinal_end, CASE WHEN {WIDE_CORPUS} OR nw >= 3 AND (full_ >= 0.34 OR len(kept) >= 2 AND len(list_filter(longs, lambda y: len(list_filter(kept, lambda x: {NEAR.format(a='x', b='y', t='0.72')})) > 0)) > 0) THEN greatest(full_, fragment_) ELSE full_ END AS score FROM w1),
two AS MATERIALIZED (SELECT * FROM (SELECT * FROM one UNION ALL SELECT * FROM near_spans) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, group_id, ordinal, ordinal_end NULLS FIRST) = 1),
o0 AS (SELECT query_id, sp.group_id, sp.ordinal, sp.ordinal_end, q, t, {RATIO.format(a='q', b='t')} AS full_ FROM two JOIN a USING (query_id), sp JOIN (SELECT group_id, min(ordinal) AS ordinal FROM c GROUP BY group_id) USING (group_id, ordinal) WHERE score < {{threshold}} AND nw >= 3 AND {WIDE_CORPUS}),
o1 AS (SELECT query_id, group_id, ordinal, ordinal_end, greatest(full_, {_fragment('q', 't')}) AS score FROM o0),
three AS (SELECT * FROM (SELECT * FROM two UNION ALL SELECT * FROM o1) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, group_id, ordinal, ordinal_end NULLS FIRST) = 1)
SELECT query_id, group_id, ordinal, ordinal_end, round(score, 6) AS score FROM three WHERE score >= {{threshold}}"""

SQL = {
    "match_items": "WITH RECURSIVE " + MATCHED.replace("{threshold}", "0.33::DOUBLE"),
    "similarity_scores": f"""WITH {PAIRS}, s AS ({_scored('SELECT * FROM p', 'text', 'nt')}),
k AS (SELECT *, CASE WHEN ordinal = top THEN 0 ELSE 0.22::DOUBLE END AS bonus_, CASE WHEN {WORDS_OF.format(x='text')} >= 2 AND length(text) >= 8 AND (full_ > 0.2 OR length(nt) > 3 * length(text)) THEN greatest(full_, fragment_) ELSE full_ END AS wide_ FROM s)
SELECT group_id, ordinal, levenshtein(text, nt) AS distance, round(fragment_, 6) AS fragment, round(direct_, 6) AS direct, round(bonus_, 6) AS bonus, round(least(1.0, wide_ + bonus_), 6) AS scoped,
  round(least(greatest(least(1.0, wide_ + bonus_) * 2 - 0.5, 0), 1), 6) AS confidence, full_ >= 0.32 OR (full_ >= 0.28 AND full_ >= 0.30) AS moves_on FROM k""",
    "stem_evidence": f"""WITH {PAIRS} SELECT group_id, ordinal, round({BEST.format(r='ns[1]')}, 6) AS best_first, {HITS.format(q='stems', r='ns')} AS distinctive,
  {HITS.format(q=f'list_filter(stems, lambda x: x NOT IN ({GENERIC}))', r=f'list_filter(ns, lambda y: y NOT IN ({GENERIC}))')} AS telling,
  len(list_filter(stems, lambda x: length(x) >= 5 AND len(list_filter(ns, lambda y: length(y) >= 5 AND {NEAR.format(a='x', b='y', t='0.78')})) > 0)) > 0 AS strong_pair,
  len(list_filter(nw, lambda w: length(w) >= 4 AND len(list_filter(nw[1:3], lambda y: {NEAR.format(a='y', b='w', t='0.85')})) > 0 AND len(list_filter(words, lambda y: {NEAR.format(a='y', b='w', t='0.85')})) = 0)) > 0 AS distinct_word,
  round(CASE WHEN len(stems) = 0 THEN 0 WHEN {LAST} >= 0.72 THEN least(greatest(0.75::DOUBLE * {LAST} + 0.20::DOUBLE * {PENULTIMATE}, 0.70), 0.95) ELSE {_tail(BEST)} END, 6) AS ending,
  round({_tail(BEST_IN)}, 6) AS tail FROM p WHERE len(ns) > 0""",
    "evidence_hits": f"""WITH RECURSIVE {PAIRS},
r AS (SELECT group_id, ordinal, 0 AS k, evidence AS rest FROM p
  UNION ALL SELECT r.group_id, r.ordinal, k + 1, CASE WHEN list_contains(rest, nl[k + 1]) THEN list_filter(rest, lambda x: x <> nl[k + 1])
    ELSE list_filter(rest, lambda x: x <> coalesce(list_filter(rest, lambda y: {NEAR.format(a='y', b='nl[k + 1]', t='0.72')})[1], '')) END
  FROM r JOIN p USING (group_id, ordinal) WHERE k < len(nl)),
h AS (SELECT group_id, ordinal, len(evidence) - len(rest) AS n, evidence, text, nt FROM r JOIN p USING (group_id, ordinal) WHERE k = len(nl)),
b AS (SELECT *, {RATIO.format(a='text', b='nt')} AS base, {WORDS_OF.format(x='text')} >= 3 AS three FROM h)
SELECT group_id, ordinal, n AS hits, n > 0 AS has_evidence, three AND (base >= 0.34 OR (len(evidence) >= 2 AND n > 0)) AS as_fragment, three AND (base >= 0.45 OR n >= 2) AS as_entry_fragment FROM b""",
    "word_alignment": f"""WITH RECURSIVE {PAIRS},
r AS (SELECT group_id, ordinal, 0 AS k, 0 AS pos, 0 AS n FROM p
  UNION ALL SELECT group_id, ordinal, k + 1, CASE WHEN best >= 0.7 THEN pos + place ELSE pos END, CASE WHEN best >= 0.7 THEN n + 1 ELSE n END FROM (
    SELECT *, coalesce(list_max(near), -1) AS best, coalesce(list_position(near, list_max(near)), 0) AS place FROM (
      SELECT r.*, list_transform(words[pos + 1:pos + 3], lambda w: 1 - levenshtein(w, nw[k + 1])::DOUBLE / greatest(length(w), length(nw[k + 1]))) AS near
      FROM r JOIN p USING (group_id, ordinal) WHERE k < len(nw))))
SELECT r.group_id, r.ordinal, CAST(n AS BIGINT) AS matched, len(nw) AS total, len(nw) > 0 AND n >= 0.2::DOUBLE * len(nw) AS covered FROM r JOIN p USING (group_id, ordinal) WHERE k = len(nw)""",
    "phrase_predicates": f"""WITH {CORPUS} SELECT group_id, ordinal, len(list_filter(list_transform(words[1:2], lambda w: {STEM}), lambda s: length(s) >= 3 AND s NOT IN ({OPENING}))) = 0 AS generic_start,
  {HAS.format(l='words', x="'is', 'was'")} AND list_contains(words, 'the') AND list_contains(list_transform(words, lambda w: {STEM}), 'thing') AS opens,
  {HAS.format(l='words', x="'is', 'was', 'as'")} AND {NEARLY.format(x='thing')} AND ({NEARLY.format(x='these')} OR list_contains(words, 'the')) AS nearly_opens, array_to_string(words[1:3], ' ') AS head, array_to_string(words[greatest(len(words) - 3, 1):], ' ') AS tail FROM c""",
    "key_lookup": f"WITH {CORPUS} SELECT group_id, ordinal, text FROM c WHERE group_id = 1 AND ordinal = 0",
    "row_count": "SELECT count(*) AS n_rows FROM conversations",
    "group_index": "SELECT conv_id AS group_id, string_agg(CAST(turn AS VARCHAR), ' ' ORDER BY turn) AS ordinals, CAST(min(turn) AS INTEGER) AS first_ordinal, CAST(max(turn) AS INTEGER) AS last_ordinal FROM conversations GROUP BY conv_id",
    "neighbours": f"WITH {CORPUS} SELECT group_id, ordinal, coalesce(lag(ordinal) OVER w, -1) AS previous_ordinal, coalesce(lead(ordinal) OVER w, -1) AS next_ordinal, sha256(coalesce(lag(text) OVER w, '')) AS previous, sha256(coalesce(lead(text) OVER w, '')) AS next FROM c WINDOW w AS (PARTITION BY group_id ORDER BY ordinal)",
    "span_backtrack": f"WITH {CORPUS}, m AS (SELECT group_id, max(ordinal) AS top FROM c GROUP BY group_id) SELECT DISTINCT group_id, ordinal FROM c JOIN m USING (group_id) WHERE ordinal BETWEEN top - 2 AND top",
    "group_match": f"WITH {HINTED} SELECT query_id, group_id, ordinal, round(direct_, 6) AS score FROM best WHERE direct_ >= 0.2",
    "hint_fallback": f"""WITH {HINTED}, other AS ({_scored("SELECT a.group_id || '/' || a.ordinal AS query_id, b.group_id, b.ordinal, a.text AS q, b.text AS t FROM f a JOIN f b ON b.group_id = a.group_id + 1", 'q', 't')}),
far AS (SELECT * FROM other QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY direct_ DESC, group_id, ordinal) = 1), good AS (SELECT * FROM best WHERE direct_ >= 0.25)
SELECT query_id, group_id, ordinal, round(direct_, 6) AS score FROM (SELECT * FROM good UNION ALL SELECT * FROM far WHERE query_id NOT IN (SELECT query_id FROM good))""",
    "stem_overlap": f"WITH {CORPUS}, x AS (SELECT CAST(item_id AS VARCHAR) AS query_id, unnest({EVIDENCE}) AS stem FROM benchmark), y AS (SELECT group_id, ordinal, unnest(evidence) AS stem FROM c) SELECT query_id, group_id, ordinal, count(*) AS shared FROM x JOIN y USING (stem) GROUP BY ALL HAVING count(*) >= 3",
    "fuzzy_theta_join": f"""WITH {CORPUS}, x AS (SELECT CAST(item_id AS VARCHAR) AS query_id, list_transform({EVIDENCE}, lambda s: {L(x='s')}) AS evidence FROM benchmark),
y AS (SELECT group_id, ordinal, list_transform({LONG}, lambda s: {L(x='s')}) AS longs FROM c),
a AS (SELECT DISTINCT unnest(evidence) AS a FROM x), b AS (SELECT DISTINCT unnest(longs) AS b FROM y), k AS (SELECT a, b FROM a, b WHERE {NEAR.format(a='a', b='b', t='0.72')})
SELECT DISTINCT query_id, group_id, ordinal FROM (SELECT query_id, unnest(evidence) AS a FROM x) JOIN k USING (a) JOIN (SELECT group_id, ordinal, unnest(longs) AS b FROM y) USING (b)""",
    "similar_stem_pairs": f"""WITH a AS (SELECT DISTINCT s AS word, {L(x='s')} AS a FROM (SELECT unnest({EVIDENCE}) AS s FROM benchmark)), b AS (SELECT DISTINCT s AS other, {L(x='s')} AS b FROM (SELECT unnest({EVIDENCE}) AS s FROM documents))
SELECT word, other, round(1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)), 6) AS ratio FROM a JOIN b ON length(a) >= 0.7 * length(b) AND length(b) >= 0.7 * length(a) WHERE {NEAR.format(a='a', b='b', t='0.72')}""",
    "scoped_scores": f"""WITH {FLAT_ROWS}, c AS (SELECT group_id, ordinal + 1 AS ordinal, text, max(ordinal + 1) OVER w AS top, min(ordinal + 1) OVER w AS low FROM f WINDOW w AS (PARTITION BY group_id)),
p AS (SELECT a.group_id || '/' || a.ordinal AS query_id, b.group_id, b.ordinal, a.text AS q, b.text AS t, CASE WHEN b.group_id = a.group_id AND b.ordinal = a.ordinal + 1 OR b.group_id = a.group_id + 1 AND b.ordinal = 1 AND a.ordinal = a.top THEN 0.22::DOUBLE ELSE 0 END AS bonus
  FROM c a JOIN c b ON b.group_id = a.group_id AND b.ordinal BETWEEN a.ordinal - 3 AND a.ordinal + 3 OR a.ordinal = a.top AND b.group_id = a.group_id + 1 AND b.ordinal = b.low),
s AS ({_scored('SELECT * FROM p', 'q', 't')})
SELECT query_id, group_id, ordinal, round(least(1.0, CASE WHEN {WORDS_OF.format(x='q')} >= 2 AND length(q) >= 8 AND (full_ > 0.2 OR length(t) > 3 * length(q)) THEN greatest(full_, fragment_) ELSE full_ END + bonus), 6) AS score FROM s""",
    "grapheme_scores": f"""WITH {PAIRS} SELECT group_id, ordinal, CAST(2 * length(text) - length(replace(text, 'e', '')) AS INTEGER) AS n_points, CAST(length(text) AS INTEGER) AS n_clusters, levenshtein(text, nt) AS distance,
  CASE WHEN greatest(length(text), length(nt)) = 0 THEN 1.0 ELSE round(1 - levenshtein(text, nt)::DOUBLE / greatest(length(text), length(nt)), 6) END AS ratio FROM p""",
    "sliding_looks": """WITH e AS (SELECT user_id AS session_id, epoch_us(ts) AS t, CAST(value AS DOUBLE) AS v FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
l(mode, len, least) AS (VALUES ('discovery', 12600000000, 3), ('tracking', 8100000000, 2)),
w AS (SELECT session_id, mode, least, v, t, t - t % 720000000 - k * 720000000 + len AS stop FROM e, l, unnest(range(0, 18)) AS u(k) WHERE t - t % 720000000 - k * 720000000 + len > t),
s AS (SELECT session_id, mode, stop, least, count(*) AS chunks, count(*) AS samples, count(*) FILTER (t >= stop - 720000000) AS fresh, sqrt(sum(v * v) / count(*)) AS rms, max(abs(v)) AS peak FROM w GROUP BY session_id, mode, stop, least)
SELECT session_id, mode, strftime(make_timestamp(stop), '%Y-%m-%d %H:%M:%S') AS ends, chunks, samples, fresh, round(rms, 6) AS rms, round(peak, 6) AS peak,
CASE WHEN samples < least THEN 'too_short' WHEN fresh < 1 THEN 'stale' WHEN rms < 20 OR peak < 40 THEN 'silence' ELSE 'speech' END AS status FROM s""",
    "top_seeds": f"""WITH {CANDIDATES}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, group_id, ordinal) AS rank FROM r) SELECT query_id, rank, group_id, ordinal, score FROM k WHERE rank <= 20""",
    "ambiguous_rows": f"WITH {NAMED} SELECT query_id, group_id, ordinal, score FROM best b WHERE EXISTS (SELECT 1 FROM named n WHERE n.query_id = b.query_id AND (n.group_id <> b.group_id OR n.ordinal <> b.ordinal) AND n.score >= b.score - 0.05::DOUBLE)",
    "unrivalled_rows": f"WITH {NAMED} SELECT query_id, group_id, ordinal, score FROM named n WHERE ordinal = query_id - 1 AND NOT EXISTS (SELECT 1 FROM best b WHERE b.query_id = n.query_id AND b.group_id <> n.group_id AND b.score >= n.score + 0.2::DOUBLE)",
    "contained_best": f"""WITH {FLAT_ROWS}, s AS (SELECT a.group_id, a.ordinal AS first, a.group_id || '/' || a.ordinal AS query_id, array_to_string(b.words[1:5], ' ') AS q FROM f a JOIN f b ON a.group_id = b.group_id AND b.ordinal = a.ordinal + 1 JOIN f e ON a.group_id = e.group_id AND e.ordinal = a.ordinal + 2),
x AS ({_scored('SELECT query_id, s.group_id, f.ordinal, q, f.text AS t FROM s JOIN f ON s.group_id = f.group_id AND f.ordinal BETWEEN first AND first + 2', 'q', 't')}),
y AS (SELECT *, CASE WHEN {WORDS_OF.format(x='q')} >= 2 THEN greatest(full_, fragment_) ELSE full_ END AS score_ FROM x)
SELECT query_id, group_id, ordinal, round(score_, 6) AS score FROM y QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score_ DESC, group_id, ordinal) = 1""",
    "speech_gate": "WITH s AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)) AS r, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS p, len(list_filter(embedding, lambda x: abs(x::DOUBLE) >= 0.0875)) / len(embedding) AS k, len(embedding) / 64 AS seconds FROM embeddings) SELECT vec_id, round(k, 6) AS frame_ratio, round(seconds, 6) AS seconds FROM s WHERE r >= 0.05 AND p >= 0.1 AND k >= 0.4",
    "znorm": "WITH e AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), z AS (SELECT vec_id, i, (x - avg(x) OVER w) / greatest(stddev_pop(x) OVER w, 1e-10) AS z FROM e WINDOW w AS (PARTITION BY vec_id)) SELECT vec_id, round(sum(z * i), 4) AS weighed, round(sum(z * z), 4) AS squares FROM z GROUP BY vec_id",
    "rolling_windows": "WITH e AS (SELECT *, epoch_us(ts) AS s FROM events) SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW) AS buffered, round(sum(value) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 12600000000 PRECEDING AND CURRENT ROW), 2) AS discovery, round(sum(value) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 8100000000 PRECEDING AND CURRENT ROW), 2) AS tracking, round(sum(value) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS newest FROM e",
    "replay_metrics": """WITH s AS (SELECT user_id AS session_id, epoch_us(ts) + event_id / 1e6::DOUBLE AS ts, CASE event_type WHEN 'error' THEN 'lost' WHEN 'signup' THEN 'recovered' ELSE 'followed' END AS reason, CAST(event_id % 11 AS INTEGER) AS ordinal, CAST(event_id % 3 AS INTEGER) AS g FROM events),
l AS (SELECT *, coalesce(lag(reason) OVER (PARTITION BY session_id ORDER BY ts) = 'lost', false) AS after_loss FROM s),
b AS (SELECT *, max(ordinal) OVER (PARTITION BY session_id, g ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l WHERE reason <> 'lost'),
p AS (SELECT session_id, count(DISTINCT g) AS groups, max_by(g, ts) AS last_group, count(*) FILTER (ordinal < before) AS regressions, count(*) FILTER (ordinal - before > CASE WHEN after_loss OR reason = 'recovered' THEN 6 ELSE 1 END) AS leaps FROM b GROUP BY session_id),
r AS (SELECT session_id, g AS last_group, max(ordinal) AS reach FROM b GROUP BY session_id, g), n AS (SELECT session_id, count(*) FILTER (reason = 'lost') AS returns FROM s GROUP BY session_id)
SELECT session_id, returns, groups, regressions, leaps, last_group, reach FROM n LEFT JOIN p USING (session_id) LEFT JOIN r USING (session_id, last_group)""",
    "latency": "SELECT user_id AS session_id, count(*) AS windows, round(avg(value), 4) AS mean_seconds, max(value) AS longest_seconds FROM events WHERE value IS NOT NULL GROUP BY user_id",
    "newest_events": "SELECT user_id AS session_id, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 32",
    "expected_rows": "WITH e AS (SELECT conv_id, max(turn) AS t, max(turn) FILTER (role = 'user') AS u FROM conversations GROUP BY conv_id) SELECT conv_id AS session_id, t AS expected_ordinal, u AS predicted_ordinal, coalesce(t = u, false) AS matched FROM e",
}

ALL = (
    similarity_scores, stem_evidence, evidence_hits, word_alignment, phrase_predicates, key_lookup, row_count, group_index, neighbours, span_backtrack, group_match, hint_fallback,
    stem_overlap, fuzzy_theta_join, similar_stem_pairs, fragment_places, scoped_scores, grapheme_scores, sliding_looks, top_seeds, match_items, ambiguous_rows, unrivalled_rows, contained_best, speech_gate, znorm, rolling_windows, replay_metrics, latency, newest_events, expected_rows, tracker_replay,
)
