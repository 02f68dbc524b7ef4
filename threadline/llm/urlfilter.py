"""URL filters: a blocked Bloom filter of listed URLs, an exact join behind it, and host/path rules above both."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from threadline.durable import durable, small_batches

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A block is 8 words of 64 bits, a cache line; each URL sets 8 bits of one block.
BLOCK_WORDS = 8
BITS_PER_URL = 16
#: The filter never takes more; a longer list only passes more URLs to the exact join.
MAX_FILTER_BYTES = 32 << 20
#: A list of at most so many bytes of URLs is broadcast to the join; a longer one is shuffled, with the possible hits only, and the
#: pages are scanned twice.
BROADCAST_BYTES = 8 << 20
#: Query parameters that don't tell pages apart.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid|mc_cid|mc_eid)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


def split_url(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for a url without ://."""
    rest = F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def canonical_url(url: str) -> Column:
    """One form for the URLs of a page: no scheme, www., fragment, tracking parameters, index file or trailing slash; the
    host's A-Z in lower case, what is left of the query sorted. Null for null and for a url without ://."""
    host, path = split_url(url)
    query = F.regexp_extract(F.col(url), r"^[^?#]*\?([^#]*)", 1)
    left = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^" + TRACKING + "(=|$)"))
    query = F.when(F.size(left) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(left), "&"))).otherwise("")
    path = F.regexp_replace(F.regexp_replace(path, r"/index\.html?$", "/"), r"/+$", "")
    return F.when(F.instr(F.col(url), "://") > 0, F.concat(F.regexp_replace(host, r"^www\.", ""), path, query))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The fitting rule of the longest host and path, as struct(rule, verdict); null if none fits. Of equally long ones the first by name."""
    order = sorted(rules, key=lambda r: (-len(r.host + r.path), r.host + r.path))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in reversed(order):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def bloom_blocks(listed: DataFrame, url: str) -> tuple[int, np.ndarray]:
    """The filter of the distinct values of listed[url]: its blocks, as an array of blocks x 8 words.

    Only the filter's words come to the driver, MAX_FILTER_BYTES at most.
    """
    n = listed.select(F.approx_count_distinct(url)).first()[0]
    blocks = 1 << max(0, (n * BITS_PER_URL // (64 * BLOCK_WORDS)).bit_length())
    blocks = min(blocks, MAX_FILTER_BYTES // (8 * BLOCK_WORDS))
    h = F.xxhash64(F.col(url))
    bit = lambda i: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_h2, {6 * i}) & 63 as int))")
    rows = listed.where(F.col(url).isNotNull()).select((h.bitwiseAND(F.lit(blocks - 1).cast("long"))).alias("_b"), F.xxhash64(F.col(url), F.lit(1)).alias("_h2"))
    rows = rows.groupBy("_b").agg(*[F.bit_or(bit(i)).alias(f"w{i}") for i in range(BLOCK_WORDS)])
    out = np.zeros((blocks, BLOCK_WORDS), np.int64)
    pdf = rows.toPandas()
    if len(pdf):
        out[pdf["_b"].to_numpy()] = pdf[[f"w{i}" for i in range(BLOCK_WORDS)]].to_numpy()
    return blocks, out


def in_bloom(blocks: int, words: np.ndarray, spark):
    """A predicate on (xxhash64(url), xxhash64(url, 1)): false only for URLs that are not listed."""
    shared = spark.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def possible(h: pd.Series, h2: pd.Series) -> pd.Series:
        block = shared.value[h.fillna(0).to_numpy(np.int64) & (blocks - 1)]
        second = h2.fillna(0).to_numpy(np.int64).view(np.uint64)
        hit = np.ones(len(h), bool)
        for i in range(BLOCK_WORDS):
            hit &= (block[:, i].view(np.uint64) >> ((second >> np.uint64(6 * i)) & np.uint64(63))) & np.uint64(1) > 0
        return pd.Series(hit)

    return possible


def judge_urls(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = (), url: str = "url", listed_url: str = "url") -> DataFrame:
    """pages with host, path, rule, listed (whether the canonical url is that of a listed one) and verdict, allow or block.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest wins, and its verdict holds.
    Without a rule, listed urls are blocked and all others allowed. URLs that the Bloom filter passes are joined with the list
    itself; the others can't be listed and never meet the join. A url that is null or without :// is never listed. Repeated rows are judged each by
    itself; an empty list blocks nothing. Columns of the five names are replaced, all others pass through.
    """
    spark, pages = pages.sparkSession, pages.drop("host", "path", "rule", "listed", "verdict")
    small_batches(spark)
    wanted = durable(listed.select(canonical_url(listed_url).alias("_u")).where("_u is not null").distinct())
    size = wanted.agg(F.sum(F.octet_length("_u"))).first()[0] or 0
    blocks, words = bloom_blocks(wanted, "_u")
    host, path = split_url(url)
    rows = pages.select(F.struct("*").alias("_kept"), host.alias("_host"), path.alias("_path"), canonical_url(url).alias("_c"))
    rows = rows.withColumn("_r", rule_of(F.col("_host"), F.col("_path"), rules))
    rows = rows.withColumn("_may", F.col("_c").isNotNull() & in_bloom(blocks, words, spark)(F.xxhash64(F.col("_c")), F.xxhash64(F.col("_c"), F.lit(1))))
    exact = wanted.select("_u", F.lit(True).alias("_hit"))
    if size <= BROADCAST_BYTES:  # one pass: what the filter rules out has no key, and meets nothing
        rows = rows.withColumn("_key", F.when(F.col("_may"), F.col("_c"))).join(F.broadcast(exact), F.col("_key") == F.col("_u"), "left")
        rows = rows.withColumn("_listed", F.coalesce("_hit", F.lit(False)))
    else:
        columns = ["_kept", "_host", "_path", "_r"]
        other = rows.where("not _may").select(*columns, F.lit(False).alias("_listed"))
        possible = rows.where("_may").join(exact, F.col("_c") == F.col("_u"), "left")
        rows = other.union(possible.select(*columns, F.coalesce("_hit", F.lit(False)).alias("_listed")))
    verdict = F.coalesce(F.col("_r.verdict"), F.when(F.col("_listed"), "block").otherwise("allow"))
    return rows.select("_kept.*", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_r.rule").alias("rule"), F.col("_listed").alias("listed"), verdict.alias("verdict"))
