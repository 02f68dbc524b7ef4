"""Words that are nearly the same, found by equi-joins: no word meets all others.

A pair is wanted where 1 - distance / longer length reaches a threshold, so the longer word's length says how many edits are
allowed. Up to DELETED edits, both words lose that many letters in all ways, and words that are so close share what is left. For
more, the longer word is cut into one segment more than edits are allowed: one of them stands unchanged in the other, near its
place. What is found so is then compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from threadline.durable import written
from threadline.functions.similarity import ratio

#: The most edits for which all deletions are listed: of 14 letters, 3 give 470 keys.
DELETED = 3


def edits(length: Column, threshold: float) -> Column:
    """How many edits words may be apart of which the longer has so many letters; rather one too many than too few."""
    return F.floor((1 - threshold) * length + 1e-9).cast("int")


def _edits(length: int, threshold: float) -> int:
    return int((1 - threshold) * length + 1e-9)


def _mixed(values: np.ndarray) -> np.ndarray:
    """64-bit numbers that differ in about half of their bits (splitmix64)."""
    x = values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The base of the hashes, odd so that it has an inverse modulo 2 ** 64: what follows a gap moves down by a product with it.
BASE = 0x9E6C63D0876A9A35
INVERSE = pow(BASE, -1, 1 << 64)
#: Words hashed at once, and the 64-bit words of the filter of the left side's keys at most (8 MB).
WORDS, FILTER = 2048, 1 << 20
RESTS, LEFT_CUT, RIGHT_CUT = range(3)


def _powers(base: int, n: int) -> np.ndarray:
    out, x = [], 1
    for _ in range(n):
        out.append(x)
        x = x * base % (1 << 64)
    return np.array(out, np.uint64)


def _sizes(threshold: float) -> tuple[int, list[int]]:
    """The least length of words that are cut, and the lengths of their segments."""
    first = next(n for n in range(1, 100_000) if _edits(n, threshold) > DELETED)
    return first, sorted({(i + 1) * n // (k + 1) - i * n // (k + 1) for n in range(first, first + 400) for k in [_edits(n, threshold)] for i in range(k + 1)})


def _keys(words: list[str], threshold: float, left: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The keys of words of one length: columns of keys, one for each word, with the place in the word that each stands for (rests: 0).

    A key is a polynomial hash of letters. Short words give what is left without up to k letters; long ones their segments, which the other
    side's pieces meet. What the sides look for in each other is kept apart by the kind in the key.
    """
    n, many = len(words[0]), len(words)
    k, (first, sizes) = _edits(n, threshold), _sizes(threshold)
    letters = _mixed(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(many, n)) * _powers(BASE, n)
    until = np.concatenate([np.zeros((many, 1), np.uint64), np.cumsum(letters, axis=1, dtype=np.uint64)], axis=1)
    back = _powers(INVERSE, n + 1)

    def pieces(at: np.ndarray, to: np.ndarray, kind: int):
        return _mixed((until[:, to] - until[:, at]) * back[at] + np.uint64(kind)), at

    if k <= DELETED:
        for gone in range(min(k, n) + 1):
            lost = np.array(list(combinations(range(n), gone)), np.int64).reshape(comb(n, gone), gone)
            rest = until[:, lost[:, 0]] if gone else until[:, [n]]
            for i in range(gone):
                end = until[:, lost[:, i + 1]] if i + 1 < gone else until[:, [n]]
                rest = rest + (end - until[:, lost[:, i] + 1]) * back[i + 1]
            yield _mixed(rest + np.uint64(RESTS)), np.zeros(len(lost), np.int64)
    else:
        edges = np.arange(k + 2) * n // (k + 1)
        yield pieces(edges[:-1], edges[1:], LEFT_CUT if left else RIGHT_CUT)
    if n >= first - DELETED - 1:
        for size in sizes:
            at = np.arange(max(0, n - size + 1))
            yield pieces(at, at + size, RIGHT_CUT if left else LEFT_CUT)


def _keyed(words: DataFrame, threshold: float, left: bool, marks: Broadcast | None = None) -> DataFrame:
    """word, key and at; with marks only keys that may be among those of the other side."""

    def run(batches):
        known = None if marks is None else marks.value
        for batch in batches:
            by_length: dict[int, list[str]] = {}
            for w in batch.column(0).to_pylist():
                by_length.setdefault(len(w), []).append(w)
            for same in by_length.values():
                for a in range(0, len(same), WORDS):
                    some = same[a : a + WORDS]
                    for keys, at in _keys(some, threshold, left):
                        here = np.ones(keys.shape, bool) if known is None else (known[keys >> np.uint64(6) & np.uint64(len(known) - 1)] >> (keys & np.uint64(63))) & np.uint64(1) > 0
                        row, place = np.nonzero(here)
                        key, at = keys[row, place], at[place]
                        order = np.lexsort((at, key, row))
                        row, key, at = row[order], key[order], at[order]
                        new = np.ones(len(row), bool)
                        new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1]) | (at[1:] != at[:-1])
                        word = pa.array(some, pa.string()).take(pa.array(row[new]))
                        yield pa.RecordBatch.from_arrays([word, pa.array(key[new].view(np.int64)), pa.array(at[new].astype(np.int32))], names=["word", "key", "at"])

    return words.mapInArrow(run, "word string, key long, at int")


def _marks(keys: DataFrame) -> Broadcast:
    """A Bloom filter of one bit for each key: what it doesn't mark meets nothing. With many keys it lets all through, and nothing else changes."""
    size = min(FILTER, 1 << max(10, keys.count().bit_length() - 1))
    cell = F.shiftrightunsigned("key", 6).bitwiseAND(F.lit(size - 1).cast("long")).alias("cell")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("key").bitwiseAND(F.lit(63).cast("long")).cast("int")).alias("bit")
    found = keys.select(cell, bit).groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    marks = np.zeros(size, np.uint64)
    marks[found.column("cell").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(marks)


def similar_words(left: DataFrame, right: DataFrame, threshold: float = 0.72) -> DataFrame:
    """word (of left), other (of right) and ratio of all pairs with a ratio of the threshold or more; equal words are pairs as well.

    left and right have a column word; repeated ones count once, null and empty ones are no words. 0.5 <= threshold < 1. Keys
    are hashes of distinct words' rests and segments, made in numpy; of the right ones only those travel that a filter of the left ones, of 8 MB
    at most, lets through, so left should be the smaller side. Empty tables give an empty one. Every pair is
    found: two words of at most k edits have a common rest, which the longer one reaches by k deletions at most and the
    shorter one by as many as its own length allows.
    """
    if not 0.5 <= threshold < 1:
        raise ValueError("the threshold must be at least 0.5 and less than 1")
    a = left.select("word").where("word <> ''").distinct()
    b = right.select("word").where("word <> ''").distinct()
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, as words are few in bytes and dear in work
    own = written(_keyed(a.repartition(tasks), threshold, True))
    others = _keyed(b.repartition(tasks), threshold, False, _marks(own))
    met = own.select(F.col("word").alias("a"), "key", "at").join(others.select(F.col("word").alias("b"), "key", F.col("at").alias("start")), "key")
    allowed = edits(F.greatest(F.length("a"), F.length("b")), threshold)
    met = met.where((F.abs(F.length("a") - F.length("b")) <= allowed) & (F.abs(F.col("at") - F.col("start")) <= allowed))
    found = met.where(F.expr("levenshtein(a, b)") <= allowed).select("a", "b").distinct()
    scored = found.select(F.col("a").alias("word"), F.col("b").alias("other"), ratio(F.col("a"), F.col("b")).alias("ratio"))
    return scored.where(F.col("ratio") >= threshold)
