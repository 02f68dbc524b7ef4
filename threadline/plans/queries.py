"""The library's operators as queries over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from threadline.functions import signal, similarity, text
from threadline.functions.features import mel_features
from threadline.inference import check_widths
from threadline.operators import corpus as corpora, decode, ordered, search

P = text.LATIN


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "conversations").select(F.col("conv_id").alias("group_id"), F.col("turn").cast("int").alias("ordinal"), F.col("text").alias("raw_text"), F.col("text").alias("clean_text"))
    return corpora.prepare(rows, P)


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return search.queries(_t(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("raw_text")), P)


def text_normalize(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.normalize(F.col("text"), P).alias("normalized"))


def text_words(spark, d):
    w = _t(spark, d, "documents").select("doc_id", text.words(F.col("text"), P).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), text.character_total(F.col("w")).cast("long").alias("n_letters"))


def stem_tokens(spark, d):
    return _corpus(spark, d).select("group_id", "ordinal", F.array_join(F.array_sort("evidence"), " ").alias("evidence"))


def informative_filter(spark, d):
    c = _corpus(spark, d)
    return c.select("group_id", "ordinal", text.is_publishable(F.col("words")).alias("publishable"), text.is_continuation(F.col("words")).alias("continuation"), text.is_global_content(F.col("words")).alias("global_content"))


def levenshtein_ratio(spark, d):
    n = _t(spark, d, "nation").select("n_name")
    both = n.alias("x").join(n.alias("y"), F.col("x.n_name") < F.col("y.n_name"))  # 25 fixed rows
    return both.select(F.col("x.n_name").alias("a"), F.col("y.n_name").alias("b"), similarity.distance(F.col("x.n_name"), F.col("y.n_name")).cast("long").alias("distance"), F.round(similarity.ratio(F.col("x.n_name"), F.col("y.n_name")), 6).alias("ratio"))


def partial_ratio(spark, d):
    both = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") >= F.col("r_regionkey"))
    return both.select("n_name", "r_name", F.round(similarity.partial_ratio(F.col("n_name"), F.col("r_name")), 6).alias("partial"))


def stem_index(spark, d):
    return corpora.stem_index(_corpus(spark, d)).groupBy("stem").agg(F.count("*").alias("n_rows"), F.countDistinct("group_id").alias("n_groups"))


def index_prune(spark, d):
    found = search.sharing_a_stem(_queries(spark, d), _corpus(spark, d))
    return found.groupBy("query_id").agg(F.count("*").alias("n_candidates"))


def group_lookup(spark, d):
    return corpora.group(_corpus(spark, d), 1).select("group_id", "ordinal", "text")


def end_flags(spark, d):
    return corpora.end_flags(_corpus(spark, d))


def span_concat(spark, d):
    return corpora.spans(_corpus(spark, d)).select("group_id", "ordinal", "ordinal_end", "text")


def opening_rows(spark, d):
    return _corpus(spark, d).where("ordinal = first_ordinal").select("group_id", "ordinal", "text")


def scoped_band_join(spark, d):
    c = _corpus(spark, d).select("group_id", "ordinal")
    near = c.select("group_id", F.col("ordinal").alias("current"), F.explode(F.sequence(F.col("ordinal") - 3, F.col("ordinal") + 3)).alias("ordinal"))
    return near.join(c, ["group_id", "ordinal"]).select("group_id", "current", "ordinal")


def signal_quality(spark, d):
    q = signal.quality(F.col("embedding"), sample_rate=64, min_rms=0.05, min_peak=0.1, clip=0.3)
    e = _t(spark, d, "embeddings").select("vec_id", q.alias("q"))
    return e.select("vec_id", *[F.round(f"q.{c}", 6).alias(c) for c in ("rms", "peak", "decibels", "clipped")], "q.status")


def preemphasis(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", F.posexplode(signal.preemphasis(F.col("embedding"))).alias("i", "y"))
    return e.groupBy("vec_id").agg(F.round(F.sum(F.col("y") * (F.col("i") + 1)), 4).alias("weighed"))


def argmax_collapse(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", "label", (signal.argmax(F.col("embedding")) % 4).alias("token_id"))
    e = ordered.with_previous(e, ["label"], ["vec_id"], b=F.col("token_id"))
    return e.where("(b is null or b <> token_id) and token_id <> 3").groupBy("label").agg(F.count("*").alias("n_tokens"), F.sum("token_id").cast("long").alias("token_sum"))


def ctc_decode(spark, d):
    steps = _t(spark, d, "embeddings").select(F.col("label").alias("session_id"), F.col("vec_id").alias("t"), F.col("embedding").alias("logits"))
    vocabulary = spark.createDataFrame([(i, ("▁" if i % 5 == 0 else "") + f"t{i}") for i in range(63)], "token_id int, token string")
    return decode.decode(check_widths(steps, 64), vocabulary, 63).select(F.col("session_id").alias("label"), "text")


def stall_gaps(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id", "ts")
    e = ordered.with_previous(e, ["user_id"], ["ts", "event_id"], before=F.col("ts"))
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))) / 1e6
    return e.withColumn("gap", gap).where("gap > 2").groupBy("user_id").agg(F.count("*").alias("n_gaps"), F.round(F.max("gap"), 3).alias("longest"))


def confirm_streaks(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    e = ordered.with_previous(e, ["user_id"], ["ts", "event_id"], before=F.col("event_type"))
    e = e.withColumn("new", F.coalesce((F.col("before") != F.col("event_type")).cast("int"), F.lit(1)))
    e = ordered.with_running(e, ["user_id"], ["ts", "event_id"], sums={"run": F.col("new")})
    return e.groupBy("user_id", "run").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max("n").alias("longest_run"), F.count("*").alias("n_runs"))


def newest_n_per_session(spark, d):
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return _t(spark, d, "events").withColumn("rn", F.row_number().over(order)).where("rn <= 32").groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def monotonic_check(spark, d):
    e = _t(spark, d, "events").select("user_id", "ts", "event_id", F.pmod("event_id", F.lit(7)).alias("step"))
    e = ordered.with_running(e, ["user_id"], ["ts", "event_id"], maxima={"before": F.col("step")})
    return e.groupBy("user_id").agg(F.sum((F.col("step") < F.col("before")).cast("long")).alias("regressions"), F.max("step").alias("reach"))


def sha256_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


def set_difference_words(spark, d):
    q = _queries(spark, d)
    nxt = q.select((F.col("query_id").cast("long") - 1).cast("string").alias("query_id"), F.col("evidence").alias("other"))
    both = q.join(nxt, "query_id")
    return both.select("query_id", F.size(F.array_except("evidence", "other")).cast("long").alias("only_here"), F.size(F.array_intersect("evidence", "other")).cast("long").alias("in_both"))


def best_match(spark, d):
    """For each benchmark item, the turn with the highest ratio among all that share a stem with it."""
    return search.nearest(_queries(spark, d), _corpus(spark, d), profile=P).select("query_id", "group_id", "ordinal", "score")


def mel_frames(spark, d):
    """Log-mel features of each vector as a sound: their number, and sums that change with any value of any bin or frame."""
    s = _t(spark, d, "embeddings").select("vec_id", mel_features(F.flatten(F.array_repeat("embedding", 20))).alias("m"))
    weighed = F.aggregate(F.transform("m.features", lambda x, i: x.cast("double") * (i % 97 + 1)), F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate("m.features", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return s.select("vec_id", "m.n_mels", "m.n_frames", F.size("m.features").alias("n_values"), F.round(weighed, 2).alias("weighed"), F.round(squares, 2).alias("squares"))


NORM = r"trim(regexp_replace(lower(text), '[\p{P}\p{S}\p{Z}\s]+', ' ', 'g'))"
WORDS = f"list_filter(string_split({NORM}, ' '), lambda w: w <> '')"
STEM = "CASE " + " ".join(f"WHEN ends_with(w, '{s}') AND length(w) - {len(s)} >= 3 THEN left(w, length(w) - {len(s)})" for s in P.suffixes) + " ELSE w END"
STOP = ", ".join(f"'{w}'" for w in P.stop_words)
EVIDENCE = f"list_distinct(list_filter(list_transform(list_filter({WORDS}, lambda w: length(w) >= 4 AND w NOT IN ({STOP})), lambda w: {STEM}), lambda s: length(s) >= 3))"
CORPUS = f"c AS (SELECT conv_id AS group_id, CAST(turn AS INTEGER) AS ordinal, {NORM} AS text, {WORDS} AS words, {EVIDENCE} AS evidence FROM conversations)"
QUERIES = f"q AS (SELECT CAST(item_id AS VARCHAR) AS query_id, {EVIDENCE} AS evidence FROM benchmark)"
RATIO = "1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b}))"
LEVEL = "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding))"

#: DuckDB counts bytes where Spark counts characters, so letters outside ASCII are first mapped to single bytes.
FLAT = "translate({x}, 'áàâäãçéèêëíìîïñóòôöõúùûüß', 'ABCDEFGHIJKLMNOPQRSTUVWXY')"

#: Every row that shares a stem with a query, else (in a small corpus) every row with a similar one, else every row; with its ratio.
CLOSE = "len(list_filter(x.evidence, lambda a: len(list_filter(y.longs, lambda b: 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) >= 0.72)) > 0)) > 0"
CANDIDATES = f"""{CORPUS}, q AS (SELECT CAST(item_id AS VARCHAR) AS query_id, {FLAT.format(x=NORM)} AS text, {EVIDENCE} AS evidence FROM benchmark),
n AS (SELECT DISTINCT query_id, group_id, ordinal FROM (SELECT group_id, ordinal, unnest(evidence) AS stem FROM c) JOIN (SELECT query_id, unnest(evidence) AS stem FROM q WHERE len(evidence) >= 2) USING (stem)),
fx AS (SELECT query_id, list_transform(evidence, lambda s: {FLAT.format(x='s')}) AS evidence FROM q WHERE len(evidence) >= 2 AND query_id NOT IN (SELECT query_id FROM n) AND (SELECT count(*) FROM c) <= 200),
fy AS (SELECT group_id, ordinal, list_transform(list_filter(list_transform(list_filter(words, lambda w: length(w) >= 4), lambda w: {STEM}), lambda s: length(s) >= 3), lambda s: {FLAT.format(x='s')}) AS longs FROM c),
near AS (SELECT query_id, group_id, ordinal FROM n UNION ALL SELECT query_id, group_id, ordinal FROM fx x, fy y WHERE {CLOSE}),
m AS (SELECT * FROM near UNION ALL SELECT query_id, group_id, ordinal FROM q, c WHERE query_id NOT IN (SELECT query_id FROM near)),
r AS (SELECT query_id, group_id, ordinal, round({RATIO.format(a='x', b='y')}, 9) AS score FROM (SELECT query_id, group_id, ordinal, q.text AS x, {FLAT.format(x='c.text')} AS y FROM m JOIN q USING (query_id) JOIN c USING (group_id, ordinal)))"""

SQL = {
    "best_match": f"""WITH {CANDIDATES}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, group_id, ordinal) AS rank FROM r) SELECT query_id, group_id, ordinal, score FROM k WHERE rank = 1""",
    "text_normalize": f"SELECT doc_id, {NORM} AS normalized FROM documents",
    "text_words": f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS n_letters FROM (SELECT doc_id, {WORDS} AS w FROM documents)",
    "stem_tokens": f"WITH {CORPUS} SELECT group_id, ordinal, array_to_string(list_sort(evidence), ' ') AS evidence FROM c",
    "informative_filter": f"WITH {CORPUS}, n AS (SELECT *, len(words) AS k, length(array_to_string(words, '')) AS n FROM c) SELECT group_id, ordinal, (k >= 2 AND n >= 6) OR len(list_filter(words, lambda w: length(w) >= 6)) > 0 AS publishable, k >= 2 AND n >= 5 AS continuation, k >= 3 AND n >= 10 AS global_content FROM n",
    "levenshtein_ratio": f"SELECT x.n_name AS a, y.n_name AS b, levenshtein(x.n_name, y.n_name) AS distance, round({RATIO.format(a='x.n_name', b='y.n_name')}, 6) AS ratio FROM nation x JOIN nation y ON x.n_name < y.n_name",
    "partial_ratio": "WITH p AS (SELECT n_name, r_name, CASE WHEN length(n_name) <= length(r_name) THEN n_name ELSE r_name END AS s, CASE WHEN length(n_name) <= length(r_name) THEN r_name ELSE n_name END AS l FROM nation JOIN region ON n_regionkey >= r_regionkey) SELECT n_name, r_name, round(list_max(list_transform(range(1, length(l) - length(s) + 2), lambda i: 1 - levenshtein(s, substr(l, i, length(s)))::DOUBLE / length(s))), 6) AS partial FROM p",
    "stem_index": f"WITH {CORPUS} SELECT stem, count(*) AS n_rows, count(DISTINCT group_id) AS n_groups FROM c, unnest(evidence) AS t(stem) GROUP BY stem",
    "index_prune": f"WITH {CORPUS}, {QUERIES}, a AS (SELECT group_id, ordinal, stem FROM c, unnest(evidence) AS t(stem)), b AS (SELECT query_id, stem FROM q, unnest(evidence) AS t(stem)) SELECT query_id, count(DISTINCT (group_id, ordinal)) AS n_candidates FROM a JOIN b USING (stem) GROUP BY query_id",
    "group_lookup": f"WITH {CORPUS} SELECT group_id, ordinal, text FROM c WHERE group_id = 1",
    "end_flags": f"WITH {CORPUS}, m AS (SELECT *, max(ordinal) OVER (PARTITION BY group_id) AS top FROM c) SELECT group_id, ordinal, ordinal = top AS at_end, ordinal + 2 > top AS near_end FROM m",
    "span_concat": f"WITH {CORPUS} SELECT a.group_id, a.ordinal, b.ordinal AS ordinal_end, a.text || ' ' || b.text AS text FROM c a JOIN c b ON a.group_id = b.group_id AND b.ordinal = a.ordinal + 1 UNION ALL SELECT a.group_id, a.ordinal, e.ordinal, a.text || ' ' || b.text || ' ' || e.text FROM c a JOIN c b ON a.group_id = b.group_id AND b.ordinal = a.ordinal + 1 JOIN c e ON a.group_id = e.group_id AND e.ordinal = a.ordinal + 2",
    "opening_rows": f"WITH {CORPUS} SELECT group_id, ordinal, text FROM c WHERE (group_id, ordinal) IN (SELECT group_id, min(ordinal) FROM c GROUP BY group_id)",
    "scoped_band_join": f"WITH {CORPUS} SELECT a.group_id, a.ordinal AS current, b.ordinal FROM c a JOIN c b ON a.group_id = b.group_id AND b.ordinal BETWEEN a.ordinal - 3 AND a.ordinal + 3",
    "signal_quality": f"WITH s AS (SELECT vec_id, {LEVEL} AS r, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS p, len(list_filter(embedding, lambda x: abs(x::DOUBLE) >= 0.3)) / len(embedding) AS k FROM embeddings) SELECT vec_id, round(r, 6) AS rms, round(p, 6) AS peak, round(20 * log10(greatest(r, 1e-6)), 6) AS decibels, round(k, 6) AS clipped, CASE WHEN k >= 0.005 THEN 'clipped' WHEN r < 0.05 OR p < 0.1 THEN 'silence' ELSE 'speech' END AS status FROM s",
    "preemphasis": "SELECT vec_id, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: i * (embedding[i]::DOUBLE - CASE WHEN i = 1 THEN 0 ELSE 0.97::DOUBLE * embedding[i - 1]::DOUBLE END))), 4) AS weighed FROM embeddings",
    "argmax_collapse": "WITH e AS (SELECT vec_id, label, (list_position(embedding, list_max(embedding)) - 1) % 4 AS token_id FROM embeddings), b AS (SELECT *, lag(token_id) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM e) SELECT label, count(*) AS n_tokens, CAST(sum(token_id) AS BIGINT) AS token_sum FROM b WHERE (b IS NULL OR b <> token_id) AND token_id <> 3 GROUP BY label",
    "ctc_decode": "WITH e AS (SELECT vec_id, label, list_position(embedding, list_max(embedding)) - 1 AS t FROM embeddings), b AS (SELECT *, lag(t) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM e) SELECT label, trim(coalesce(string_agg(CASE WHEN (b IS NULL OR b <> t) AND t <> 63 THEN CASE WHEN t % 5 = 0 THEN ' ' ELSE '' END || 't' || t END, '' ORDER BY vec_id), '')) AS text FROM b GROUP BY label",
    "stall_gaps": "WITH e AS (SELECT user_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6::DOUBLE AS gap FROM events) SELECT user_id, count(*) AS n_gaps, round(max(gap), 3) AS longest FROM e WHERE gap > 2 GROUP BY user_id",
    "confirm_streaks": "WITH e AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT user_id, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e), k AS (SELECT user_id, run, count(*) AS n FROM r GROUP BY user_id, run) SELECT user_id, max(n) AS longest_run, count(*) AS n_runs FROM k GROUP BY user_id",
    "newest_n_per_session": "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id, count(*) AS n, min(event_id) AS first_id FROM e WHERE rn <= 32 GROUP BY user_id",
    "monotonic_check": "WITH e AS (SELECT user_id, event_id % 7 AS step, max(event_id % 7) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) SELECT user_id, CAST(sum(CAST(step < before AS BIGINT)) AS BIGINT) AS regressions, max(step) AS reach FROM e GROUP BY user_id",
    "sha256_text": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "set_difference_words": f"WITH {QUERIES} SELECT a.query_id, CAST(len(list_filter(a.evidence, lambda x: NOT list_contains(b.evidence, x))) AS BIGINT) AS only_here, CAST(len(list_filter(a.evidence, lambda x: list_contains(b.evidence, x))) AS BIGINT) AS in_both FROM q a JOIN q b ON CAST(a.query_id AS BIGINT) + 1 = CAST(b.query_id AS BIGINT)",
}

ALL = (
    text_normalize, text_words, stem_tokens, informative_filter, levenshtein_ratio, partial_ratio, stem_index, index_prune, group_lookup, end_flags, span_concat, opening_rows,
    scoped_band_join, signal_quality, preemphasis, argmax_collapse, ctc_decode, stall_gaps, confirm_streaks, newest_n_per_session, monotonic_check, sha256_text,
    set_difference_words, best_match, mel_frames,
)
