"""Periodic runs of words: all maximal repetitions of a text, by the runs theorem."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from threadline.durable import small_batches
from threadline.llm.textbytes import ODD, chunks, mixed


class Minima:
    """Least values of ranges of an array: a sparse table over blocks, and the least value so far inside each block, both ways."""

    BLOCK = 16

    def __init__(self, values: np.ndarray):
        n = -(-len(values) // self.BLOCK)
        self.values = np.full(n * self.BLOCK, np.iinfo(np.int32).max, np.int32)
        self.values[: len(values)] = values
        square = self.values.reshape(n, self.BLOCK)
        self.upto = np.minimum.accumulate(square, 1).ravel()
        self.since = np.minimum.accumulate(square[:, ::-1], 1)[:, ::-1].ravel()
        self.table = [square.min(1)]
        while 2 << (len(self.table) - 1) <= n:
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least of values[first .. last], for arrays of first <= last."""
        a, b = first // self.BLOCK, last // self.BLOCK
        out = np.minimum(self.since[first], self.upto[last])
        between = np.flatnonzero(b - a > 1)
        if len(between):
            lo, hi = a[between] + 1, b[between]
            level = np.frexp(hi - lo)[1] - 1
            for k in np.unique(level):
                some = level == k
                at = between[some]
                out[at] = np.minimum(out[at], np.minimum(self.table[k][lo[some]], self.table[k][hi[some] - (1 << k)]))
        near = np.flatnonzero(a == b)
        if len(near):
            least, lo, hi = self.values[first[near]].copy(), first[near], last[near]
            for d in range(1, self.BLOCK):
                np.minimum(least, self.values[np.minimum(lo + d, hi)], out=least)
            out[near] = least
        return out


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order and the rank of each, by doubling: only suffixes that are still tied are sorted again. The last code must
    occur once."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    sorted_ = codes[order]
    head = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    step = 1
    while True:
        single = head & np.append(head[1:], True)
        tied = np.flatnonzero(~single)
        if not len(tied):
            return order, rank
        suffix = order[tied]
        key = rank[suffix] * (n + 1) + rank[suffix + step] + 1
        by = np.argsort(key, kind="stable")
        suffix, key = suffix[by], key[by]
        order[tied] = suffix
        head[tied[1:]] |= key[1:] != key[:-1]
        rank[suffix] = np.maximum.accumulate(np.where(head[tied], tied, 0))
        step *= 2


def _agree(codes: np.ndarray, i: int, j: int, have: int) -> int:
    """How far codes agree from i and from j, given that they do for `have`."""
    take = 64
    while True:
        m = min(take, len(codes) - max(i, j) - have)
        if m <= 0:
            return have
        other = np.flatnonzero(codes[i + have : i + have + m] != codes[j + have : j + have + m])
        if len(other):
            return have + int(other[0])
        have, take = have + m, take * 2


def common_prefixes(codes: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each suffix in order, how many codes it has in common with the one before. Compared only where the codes in front differ: elsewhere
    it is one less than for the position in front."""
    n = len(codes)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    own = (at == 0) | (before <= 0)
    rest = np.flatnonzero(~own)
    own[rest] = codes[rest - 1] != codes[before[rest] - 1]
    first = np.flatnonzero(own)
    length = np.zeros(len(first), np.int64)
    live = np.flatnonzero(before[first] >= 0)
    for have in range(16):
        i, j = first[live] + have, before[first[live]] + have
        inside = np.maximum(i, j) < n
        live = live[inside]
        live = live[codes[first[live] + have] == codes[before[first[live]] + have]]
        length[live] += 1
    for k in live:
        length[k] = _agree(codes, int(first[k]), int(before[first[k]]), 16)
    last = np.maximum.accumulate(np.where(own, at, 0))
    along = np.zeros(n, np.int64)
    along[first] = length
    along = np.maximum(along[last] - (at - last), 0)
    return along[order].astype(np.int32)


def next_less(values: np.ndarray) -> np.ndarray:
    """For each position, the next one with a smaller value, or the length: found by going up and down a tree of minima."""
    n, big = len(values), np.iinfo(np.int64).max
    level = [np.append(values, np.full((1 << max(1, (n - 1).bit_length())) - n, big))]
    while len(level[-1]) > 1:
        level.append(np.minimum(level[-1][0::2], level[-1][1::2]))
    node, found, height = np.arange(n), np.full(n, -1, np.int64), np.zeros(n, np.int8)
    live = np.arange(n)
    for h in range(len(level) - 1):
        left = live[(node[live] & 1) == 0]
        hit = left[level[h][node[left] + 1] < values[left]]
        found[hit], height[hit] = node[hit] + 1, h
        live = live[found[live] < 0]
        node[live] >>= 1
    for h in range(len(level) - 1, 0, -1):
        down = np.flatnonzero((found >= 0) & (height >= h))
        child = found[down] * 2
        found[down] = child + (level[h - 1][child] >= values[down])
    return np.where(found < 0, n, found)


class Extensions:
    """How far a string agrees with itself from two positions on."""

    def __init__(self, codes: np.ndarray):
        self.order, self.rank = suffix_array(codes)
        self.minima = Minima(common_prefixes(codes, self.order, self.rank))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        return self.minima.of(np.minimum(a, b) + 1, np.maximum(a, b))


def runs_of(codes: np.ndarray, times: int = 4, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and smallest period of each run with length >= max(least, times * period), times >= 3. codes start and end with
    codes that occur once and are less than all that are repeated.

    At each position, the longest Lyndon words under the order of the codes and under its reverse end where the rank of the suffix
    is next undercut, and next exceeded. One of the two is a root of each run, and as roots follow each other by the period, one
    of them starts within the run's first period: of those that start there, only such as reach far enough to the right are extended to the left.
    """
    n = len(codes)
    right = Extensions(codes)
    found = []
    for values in (right.rank, -right.rank):
        i, j = np.arange(n), next_less(values)
        i, j = i[j < n], j[j < n]
        end = j + right.of(i, j)
        far = end - i >= (times - 1) * (j - i) + 1
        found.append(np.stack([end[far], (j - i)[far], i[far]]))
    end, period, root = np.concatenate(found, 1)
    if not len(end):
        return (np.zeros(0, np.int64),) * 3
    by = np.lexsort((root, period, end))
    end, period, root = end[by], period[by], root[by]
    new = np.append(True, (end[1:] != end[:-1]) | (period[1:] != period[:-1]))
    end, period, root = end[new], period[new], root[new]
    left = Extensions(codes[::-1].copy())
    start = root - left.of(n - root, n - (root + period))
    good = end - start >= np.maximum(least, times * period)
    return start[good], end[good], period[good]


def _stretches(codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of three words stand that occur again in their row: all runs of four periods and six words lie in these. Hashes that
    clash only make stretches longer."""
    n = len(codes)
    if n < 6:
        return (np.zeros(0, np.int64),) * 2
    one = mixed(codes.astype(np.uint64) + ODD)
    three = mixed(mixed(one[:-2] * ODD + one[1:-1]) * ODD + one[2:]) ^ mixed(row[:-2].astype(np.uint64) * ODD)
    whole = np.flatnonzero(row[:-2] == row[2:])
    by = whole[np.argsort(three[whole], kind="stable")]
    same = three[by[1:]] == three[by[:-1]]
    again = np.zeros(len(by), bool)
    again[1:] |= same
    again[:-1] |= same
    inside = np.zeros(n + 2, bool)
    for d in range(3):
        inside[by[again] + d] = True
    inside = inside[:n]
    start = inside & np.append(True, ~inside[:-1] | (row[1:] != row[:-1]))
    stop = inside & np.append(~inside[1:] | (row[1:] != row[:-1]), True)
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def find(codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and period of the runs of all rows, whose words stand one after the other; sorted by start, then period."""
    start, stop = _stretches(codes, row)
    long = stop - start >= 6
    start, stop = start[long], stop[long]
    if not len(start):
        return (np.zeros(0, np.int64),) * 3
    # the stretches one after the other, with a code of its own before each and at the end
    size = stop - start
    first = np.cumsum(np.append(0, size[:-1] + 1)) + 1
    total = int(size.sum()) + len(size) + 1
    borders = np.append(first - 1, total - 1)
    string, place = np.empty(total, np.int64), np.zeros(total, np.int64)
    inner = np.ones(total, bool)
    inner[borders] = False
    place[inner] = np.repeat(start, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    string[inner] = codes[place[inner]] + len(borders)
    string[borders] = np.arange(len(borders))
    a, b, period = runs_of(string)
    a, b = place[a], place[b - 1] + 1
    by = np.lexsort((period, a))
    return a[by], b[by], period[by]


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after the other, and the offsets of the rows."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    values, offsets = split.flatten(), np.asarray(split.offsets, np.int64)
    offsets = offsets - offsets[0]
    full = np.asarray(pc.greater(pc.binary_length(values), 0).to_numpy(zero_copy_only=False), bool)
    return values.filter(pa.array(full)), np.append(0, np.cumsum(full))[offsets]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _judge(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    values, offsets = _words(texts)
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    codes = np.asarray(values.dictionary_encode().indices.to_numpy(zero_copy_only=False), np.int64) if len(values) else np.zeros(0, np.int64)
    a, b, period = find(codes, row)
    of = row[a]
    found = pa.StructArray.from_arrays([pa.array(a - offsets[of]), pa.array(b - a), pa.array(period)], fields=list(RUN))
    found = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), found)
    depth = np.zeros(len(codes) + 1, np.int64)
    np.add.at(depth, a + period, 1)
    np.add.at(depth, b, -1)
    kept = np.cumsum(depth[:-1]) == 0
    ends = np.append(0, np.cumsum(kept))[offsets]
    collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), values.filter(pa.array(kept))), pa.scalar(" ", pa.large_string()))
    return found, collapsed.cast(pa.string()), pa.array(np.diff(offsets))


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, runs (an array of start, length and period, by start, then period) and collapsed, the text with only the first
    period of each run.

    Words are what stands between ASCII white space, numbered from 0; a run is a longest stretch with smallest period q (words q apart
    are the same) of max(6, 4 * q) words or more. collapsed has the words that are in no run behind its first q words, joined by
    one space. Null and empty texts have no words, no runs and an empty collapsed text. Rows are judged each by itself, so
    repeated rows get equal results; long texts are one row in one task, in memory of a few hundred bytes for each word that
    stands in a repeated window of three. An empty table gives an empty one. Columns named like the results are replaced, others kept.
    """
    docs = docs.drop("n_words", "runs", "collapsed")

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "_text", 1 << 20):
                found, collapsed, n = _judge(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), n, found, collapsed], names=["_kept", "n_words", "runs", "collapsed"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("_kept"), F.col(text).alias("_text"))
    more = T.StructType.fromDDL("n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    out = rows.mapInArrow(run, T.StructType([rows.schema["_kept"], *more.fields]))
    return out.select("_kept.*", "n_words", "runs", "collapsed")


def longest(runs: Column) -> Column:
    """The run with the greatest length; of equals the first, then that of the smallest period. Null if there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r.length.alias("l"), (-r.start).alias("s"), (-r.period).alias("p"))))
    return F.when(best.isNotNull(), F.struct((-best.s).alias("start"), best.l.alias("length"), (-best.p).alias("period")))


def looped(text: Column, start: Column, period: Column) -> Column:
    """The text's words, joined by spaces, where those from `start` on repeat the `period` words that begin there."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rest = F.size(words) - start
    times = F.ceil(rest / period).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, start + 1, period), times)), F.lit(1), rest)
    return F.array_join(F.concat(F.slice(words, F.lit(1), start), tail), " ")
