"""The thirteen operators and the pipeline as queries over whole tables, and their SQL where there is one."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from threadline.llm import bpe, decontamination, langid, licenses, merkle, mixing, neardup, periodic, qualityrules, sharding, suffixindex, surrogates, urlfilter

URL_RULES = (
    urlfilter.Rule("block", "net", "/"),
    urlfilter.Rule("allow", "example.net", "/en/"),
    urlfilter.Rule("block", "example.com", "/de/"),
    urlfilter.Rule("allow", "org", "/fr/"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    placed = sharding.assign_shards(docs, 8, ties=("text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def listed_urls(pages: DataFrame) -> DataFrame:
    """The list of the URL query: canonical URLs under which more than one page was fetched."""
    return pages.select(urlfilter.canonical_url("url").alias("u")).where("u is not null").groupBy("u").count().where("count > 1").select(F.concat(F.lit("http://"), "u").alias("url"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge_urls(pages, listed_urls(pages), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = qualityrules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count("text").alias("size"))
    plan = mixing.allocate(docs, [3.0, 1.0, 2.0])
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    judged = decontamination.contamination(docs, items, ["doc_id"])
    judged = judged.select("doc_id", F.col("_n_words").cast("long").alias("n_words"), decontamination.words_hit(F.col("_hits")).alias("n_hit"), "_items")
    return judged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        decontamination.is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


#: The session's setting that holds the secret key of surrogates; without it each run draws its own.
SURROGATE_KEY = "spark.threadline.surrogates.key"


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_entities(docs, spark.conf.get(SURROGATE_KEY, None) or secrets.token_hex(16)).select("doc_id", "n_entities", "kinds", "text")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixindex.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licenses.scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scanned.select("doc_id", F.array_join("sentence_ids", " ").alias("sentence_ids"), F.array_join("licenses", " ").alias("licenses"), F.size("licenses").cast("long").alias("n_licenses"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    h, n = F.crc32(F.col("doc_id").cast("string").cast("binary")), mixing.word_count("text").cast("int")
    start = F.pmod(F.floor(h / 10), n).cast("int")
    period = (1 + F.floor((n - start) / (3 + F.pmod(F.floor(h / 10), F.lit(8))))).cast("int")
    docs = docs.select("doc_id", F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), periodic.looped(F.col("text"), start, period)).otherwise(F.col("text")).alias("text"))
    found = periodic.periodic_runs(docs).select("doc_id", "runs", "collapsed", periodic.longest(F.col("runs")).alias("best"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), F.concat(r.period.cast("string"), F.lit("\n"))))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    spoilt = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    fields = [F.col(c) for c in merkle.COLUMNS]
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", merkle.leaf(*fields).alias("leaf"), merkle.leaf(*fields[:-1], spoilt).alias("given"))
    manifest = merkle.build(docs)
    root = F.lit(manifest.root)
    proofs = manifest.proofs().withColumn("folded", merkle.folded(F.col("given"), F.col("path")))
    return proofs.select(
        "doc_id",
        merkle.shown(F.col("leaf")).alias("leaf"),
        merkle.shown(F.col("subroot")).alias("subroot"),
        merkle.shown(root).alias("root"),
        merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        merkle.shown(F.col("folded")).alias("folded_root"),
        (F.col("folded") == root).alias("verified"),
    )


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), decoded=True, keep=["doc_id"])
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_sharding, op2_neardup, op3_url_filter, op4_quality_rules, op5_mixing, op6_decontamination, op7_pii_surrogates, op8_suffix_dedup, op9_language_id, op10_license_scan, op11_periodic_runs, op12_merkle_manifest, op13_bpe)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

OP6 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS l, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS s
       FROM b, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS t(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT r, l, i, array_to_string(list_slice(w, i, i + l - 1), ' ') AS s FROM d, lengths, unnest(range(1, len(w) - l + 2)) AS t(i) WHERE len(w) >= l),
hits AS (SELECT r, dw.l, i, item FROM dw JOIN bw ON dw.s = bw.s AND dw.l = bw.l),
per AS (SELECT r, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + l)) AS t(p) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN per USING (r) LEFT JOIN items USING (r)
"""

OP3 = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest,
    list_filter(string_split(regexp_extract(coalesce(url, ''), '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_[a-z]+|ref|fbclid|gclid|mc_cid|mc_eid)(=|$)')) AS q
  FROM pages),
h AS (
  SELECT *, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
c AS (
  SELECT *, CASE WHEN rest IS NOT NULL THEN regexp_replace(host, '^www\.', '') || regexp_replace(regexp_replace(path, '/index\.html?$', '/'), '/+$', '')
    || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_sort(q), '&') ELSE '' END END AS canon FROM h),
l AS (SELECT canon FROM c WHERE canon IS NOT NULL GROUP BY canon HAVING count(*) > 1),
r AS (
  SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN l ON r.canon = l.canon
"""

#: CRC-32 by table: the 256 entries are made from the polynomial, and each document's bytes are folded over them.
OP1 = r"""
WITH steps AS (
  SELECT list(e ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS e FROM range(256) AS r(i))),
d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('0' || source, '1') AS source, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents),
crc AS (
  SELECT r, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(n), lambda i: CAST((instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1 AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM d, steps),
f AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY key, crc, n) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS f FROM d JOIN crc USING (r)),
p AS (SELECT *, row_number() OVER (ORDER BY f, key, crc, n) - 1 AS pos, count(*) OVER () AS total FROM f)
SELECT doc_id, CAST(n + 1 AS BIGINT) AS size, crc AS text_crc32, 'rows' AS law, CAST(pos * 8 // total AS INTEGER) AS shard,
  CAST(pos - ((pos * 8 // total) * total + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p
"""

OP5 = r"""
WITH d AS (
  SELECT doc_id, coalesce('0' || source, '1') AS source, md5('29:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS total, row_number() OVER (ORDER BY source) AS i FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1, 2][(i - 1) % 3 + 1] AS w, total * 2.0::DOUBLE AS cap FROM s),
o AS (
  SELECT *, (sum(total) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, total, least(cap, w * coalesce((SELECT min_by(level, (cap / w, source)) FROM o WHERE level <= cap / w), 'inf'::DOUBLE)) AS target FROM o),
q AS (SELECT d.*, total, target, sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS UNBOUNDED PRECEDING) AS c, row_number() OVER () AS r FROM d JOIN t USING (source)),
copies AS (SELECT r, key, size, n, (total::DOUBLE * n + c) / target AS finish FROM q, range(2) AS g(n) WHERE size > 0),
run AS (SELECT r, sum(size) OVER (ORDER BY finish, key, n ROWS UNBOUNDED PRECEDING) <= (SELECT sum(target) FROM t) AS taken FROM copies),
times AS (SELECT r, count(*) AS n FROM run WHERE taken GROUP BY r)
SELECT doc_id, size, total AS source_size, target, CAST(size * coalesce(n, 0) AS BIGINT) AS taken FROM q LEFT JOIN times USING (r)
"""

OP10 = r"""
WITH known(k, s) AS (VALUES {known}),
rules(n, license, ids) AS (VALUES {rules}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
v AS (SELECT r, 0 AS wrapped, text FROM d UNION ALL SELECT r, 1, regexp_replace(regexp_replace(text, '([^.!?;:\n\s])[ \t]*\n[ \t]*(\S)', '\1 \2', 'g'), '([^.!?;:\n\s])[ \t]*\n[ \t]*(\S)', '\1 \2', 'g') FROM d),
p AS (SELECT r, wrapped, i, trim(regexp_replace(lower(parts[i]), '[^a-z0-9]+', ' ', 'g')) AS s FROM (SELECT r, wrapped, regexp_split_to_array(text, '[.!?;:]+\s+|[.!?;:]*\n+') AS parts FROM v), unnest(range(1, len(parts) + 1)) AS t(i)),
w AS (SELECT *, coalesce(sum(length(replace(s, ' ', ''))) OVER (PARTITION BY r, wrapped ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_ FROM p),
f AS (SELECT DISTINCT r, at_, length(s) AS n, s, k FROM w JOIN known USING (s)),
best AS (SELECT r, string_agg(k, ' ' ORDER BY at_, n, s) AS ids FROM f GROUP BY r),
m AS (SELECT r, license, min(rules.n) AS n FROM best, rules WHERE regexp_matches(' ' || best.ids || ' ', rules.ids) GROUP BY r, license),
a AS (SELECT r, count(*) AS n, string_agg(license, ' ' ORDER BY m.n) AS licenses FROM m GROUP BY r)
SELECT doc_id, coalesce(ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses, CAST(coalesce(a.n, 0) AS BIGINT) AS n_licenses
FROM d LEFT JOIN best USING (r) LEFT JOIN a USING (r)
"""


#: The trees level by level, and each leaf's way up them; CRC-32 as in OP1.
OP12 = r"""
WITH RECURSIVE steps AS (
  SELECT list(e ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS e FROM range(256) AS r(i))),
f AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('1' || source, '0') AS g, text, {head} AS head, hex(encode(CAST(doc_id AS VARCHAR))) AS h, strlen(CAST(doc_id AS VARCHAR)) AS k FROM documents),
c AS (
  SELECT f.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(k), lambda i: CAST((instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1 AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM f, steps),
l AS (SELECT *, sha256(head || {text}) AS leaf, sha256(head || {given}) AS given FROM (SELECT *, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS given_text FROM c)),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS at_, count(*) OVER (PARTITION BY g) AS n FROM l),
nodes(g, level, at_, n, h) AS (
  SELECT g, 0, at_, n, leaf FROM placed
  UNION ALL SELECT g, level + 1, at_ // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY at_)) FROM nodes WHERE n > 1 GROUP BY g, level, at_ // 3, n),
tops AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS at_, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper_(level, at_, n, h) AS (
  SELECT 0, at_, n, h FROM tops
  UNION ALL SELECT level + 1, at_ // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY at_)) FROM upper_ WHERE n > 1 GROUP BY level, at_ // 3, n),
way(r, g, level, at_, n, x, proof) AS (
  SELECT r, g, 0, at_, n, given, '' FROM placed
  UNION ALL
  SELECT w.r, w.g, w.level + 1, w.at_ // 3, (w.n + 2) // 3, sha256(string_agg(CASE WHEN m.at_ = w.at_ THEN w.x ELSE m.h END, '' ORDER BY m.at_)),
    w.proof || coalesce(string_agg(m.h, '' ORDER BY m.at_) FILTER (m.at_ <> w.at_), '')
  FROM way w JOIN nodes m ON m.g = w.g AND m.level = w.level AND m.at_ // 3 = w.at_ // 3 WHERE w.n > 1 GROUP BY w.r, w.g, w.level, w.at_, w.n, w.x, w.proof),
last_(r, level, at_, n, x, proof) AS (
  SELECT r, 0, tops.at_, tops.n, x, proof FROM way JOIN tops USING (g) WHERE way.n = 1
  UNION ALL
  SELECT w.r, w.level + 1, w.at_ // 3, (w.n + 2) // 3, sha256(string_agg(CASE WHEN m.at_ = w.at_ THEN w.x ELSE m.h END, '' ORDER BY m.at_)),
    w.proof || coalesce(string_agg(m.h, '' ORDER BY m.at_) FILTER (m.at_ <> w.at_), '')
  FROM last_ w JOIN upper_ m ON m.level = w.level AND m.at_ // 3 = w.at_ // 3 WHERE w.n > 1 GROUP BY w.r, w.level, w.at_, w.n, w.x, w.proof)
SELECT doc_id, leaf, tops.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = root.h AS verified
FROM placed JOIN last_ USING (r) JOIN tops ON placed.g = tops.g, (SELECT h FROM upper_ WHERE n = 1) AS root WHERE last_.n = 1
"""


def _leaf_field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


def oracle_sql() -> dict[str, str]:
    known = ", ".join(f"('{k}', '{s}')" for k, s in licenses.SENTENCES.items())
    first = {r.license: i for i, r in reversed(list(enumerate(licenses.RULES)))}
    rules = ", ".join("(%d, '%s', '%s')" % (first[r.license], r.license, " " + " (?:.* )?".join(x.replace(".", r"\.") for x in r.sentences) + " ") for r in licenses.RULES)
    out = {"op1_sharding": OP1, "op3_url_filter": OP3, "op5_mixing": OP5, "op6_decontamination": OP6, "op10_license_scan": OP10.replace("{known}", known).replace("{rules}", rules)}
    out["op12_merkle_manifest"] = OP12.replace("{head}", " || ".join(_leaf_field(c) for c in merkle.COLUMNS[:-1])).replace("{text}", _leaf_field("text")).replace("{given}", _leaf_field("given_text"))
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
