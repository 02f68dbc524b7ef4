"""Suffix-array dedup: repeated byte strings across documents, found by a logarithmic family of sorted suffixes.

Only suffixes cut at WIDTH bytes matter. A window of WIDTH bytes goes to the bucket of the least k-gram in it (its anchor), with
the neighbours that share the anchor, as one run; equal windows always meet. First only hashes travel: a run that no other
document has an anchor of is done with; one that seems to equal a run of a smaller document is claimed to be covered by it, and
claims that follow each other join into long spans, whose bytes are held against each other by a digest. Only runs that share
an anchor with a different run send their bytes. There, batches of windows in document order get suffix arrays, are scanned against
the levels of earlier batches, and levels of one size merge; all of it on the bytes. No byte goes on the word of a hash alone.

An index keeps what it has seen: the sorted runs of each batch are a level, a table in its folder, and levels of one size merge. A
new batch is scanned against all levels.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from threadline.durable import durable, let_go, small_batches, written
from threadline.llm.textbytes import ODD, Spans, mixed, text_bytes

#: Bytes of a window and of an anchor; bytes of text that are cut into windows at once.
WIDTH, GRAM, SLICE = 50, 24, 1 << 20
#: Runs that a task gathers before it sends them, and bytes of text for each bucket.
GATHER, BUCKET = 500_000, 8 << 20
#: Buckets that a task deals to at once; a larger table is dealt twice, into as many parts of each bucket as it needs.
FANOUT = 1 << 14
#: Windows in a batch of the family, and bytes of runs that are hashed at once.
BATCH, HASHED = 1 << 16, 1 << 18
#: Runs of one anchor that a task takes in; the windows of those of a more frequent one are counted by Spark.
HOT = 50_000
#: Byte ranges that are asked of one copy of a document.
ASKED = 4096


def super_windows(data: np.ndarray, last: np.ndarray, spans: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, anchor): runs of windows that share an anchor; start and end - 1 are where their first and last windows begin.

    last: for each byte, whether it can begin a window (WIDTH bytes of its own document follow).
    """
    n = len(data) - WIDTH + 1
    if n <= 0 or not last[:n].any():
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    rolling = mixed((spans.sums[GRAM:] - spans.sums[:-GRAM]) * spans.down[: len(data) - GRAM + 1])
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    value = rolling & ~low | np.arange(len(rolling), dtype=np.uint64)
    width, least = 1, value
    span = WIDTH - GRAM + 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (span - width)], least[span - width :])[:n]
    at = (least & low).astype(np.int64)
    ok = last[:n]
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | ~ok[:-1]
    start = np.flatnonzero(new & ok)
    stop = np.ones(n, bool)
    stop[:-1] = new[1:] | ~ok[1:]
    end = np.flatnonzero(stop & ok) + 1
    return start, end, mixed(rolling[at[start]] * ODD)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] .. and so on, one after the other."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - (total - size), size)


def slices(data: np.ndarray, offsets: np.ndarray):
    """(document, start in it, windows, anchor, hash of the bytes) of all runs of some texts, a slice at a time."""
    for base in range(0, len(data), SLICE):
        part = data[base : base + SLICE + WIDTH - 1]
        here = min(SLICE, len(data) - base)
        first, final = np.searchsorted(offsets, base, "right") - 1, np.searchsorted(offsets, base + here, "left")
        last = np.zeros(len(part), bool)
        for a, b in zip(np.maximum(offsets[first:final] - base, 0), offsets[first + 1 : final + 1] - WIDTH + 1 - base, strict=True):
            last[a : max(a, min(b, here))] = True
        spans = Spans(part)
        start, end, anchor = super_windows(part, last, spans)
        if len(start):
            doc = np.searchsorted(offsets, start + base, "right") - 1
            yield doc, start + base - offsets[doc], end - start, anchor, spans.of(start, end + WIDTH - 1)


#: Of each different run: difference of anchors, hash (low and high part), windows, occurrences; of each occurrence: document
#: and where it starts; of each document: id and row key.
KINDS = [np.uint32, np.uint32, np.uint8, np.uint8, np.uint16, np.uint32, np.uint32, np.int64, np.int64]


def _packed(runs: tuple[np.ndarray, ...], bucket: np.ndarray, short: np.ndarray):
    """(bucket, blob) of runs (id, key, start, windows, content); equal runs are sent once, with all their occurrences."""
    ids, keys, where, windows, content = runs
    press = zstandard.ZstdCompressor(level=1)
    order = np.lexsort((ids, content, (bucket << 32) | short))
    ids, keys, where, windows, content, bucket, short = (x[order] for x in (ids, keys, where, windows, content, bucket, short))
    new = np.ones(len(ids), bool)
    new[1:] = (content[1:] != content[:-1]) | (short[1:] != short[:-1]) | (bucket[1:] != bucket[:-1])
    at = np.arange(len(new))
    new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % 60_000 == 0  # no more occurrences than their count can say
    head = np.flatnonzero(new)
    times = np.diff(np.append(head, len(ids)))
    cuts = np.append(np.flatnonzero(np.append(True, bucket[head][1:] != bucket[head][:-1])), len(head))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        h = head[a:b]
        x, y = h[0], h[-1] + times[b - 1]
        pick, which = _numbered(ids[x:y], keys[x:y])
        arrays = (
            np.diff(short[h], prepend=0),
            content[h] & np.uint64(0xFFFFFFFF),
            (content[h] >> np.uint64(32)) & np.uint64(0xFF),
            windows[h],
            times[a:b],
            which,
            where[x:y],
            ids[x:y][pick],
            keys[x:y][pick],
        )
        yield int(bucket[h[0]]), press.compress(b"".join(len(v).to_bytes(8, "little") + v.astype(k).tobytes() for v, k in zip(arrays, KINDS, strict=True)))


def _numbered(ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct (id, key) stands first, and each one's number."""
    order = np.lexsort((keys, ids))
    new = np.append(True, (ids[order][1:] != ids[order][:-1]) | (keys[order][1:] != keys[order][:-1]))
    which = np.empty(len(ids), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def deal(gathered: list[tuple], buckets: int):
    """(bucket, blob) of gathered (id, key, start, windows, anchor, content)."""
    ids, keys, where, windows, anchor, content = (np.concatenate(x) for x in zip(*gathered, strict=True))
    bucket, short = (anchor >> np.uint64(40)).astype(np.int64) % buckets, (anchor & np.uint64(0xFFFFFFFF)).astype(np.int64)
    yield from _packed((ids, keys, where, windows, content), bucket, short)


def _unpack(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    for kind in KINDS:
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(np.frombuffer(raw, kind, n, at + 8))
        at += 8 + n * np.dtype(kind).itemsize
    return out


def _runs(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of some blobs: anchor, content, windows of each run, and of each occurrence its run, start, id and key."""
    unpress = zstandard.ZstdDecompressor()
    parts = [_unpack(unpress.decompress(b)) for b in blobs]
    anchor = np.concatenate([np.cumsum(p[0].astype(np.int64)) for p in parts])
    content = np.concatenate([(p[2].astype(np.int64) << 32) | p[1] for p in parts])
    windows, times = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (3, 4))
    where = np.concatenate([p[6] for p in parts]).astype(np.int64)
    ids, keys = np.concatenate([p[7][p[5]] for p in parts]), np.concatenate([p[8][p[5]] for p in parts])
    return anchor, content, windows, np.repeat(np.arange(len(anchor)), times), where, ids, keys


def redeal(bucket: int, blobs: list[bytes], parts: int):
    """(part, blob) of a bucket's blobs, by other bits of the anchors."""
    anchor, content, windows, run, where, ids, keys = _runs(blobs)
    yield from _packed((ids, keys, where, windows[run], content[run].view(np.uint64)), bucket * parts + anchor[run] % parts, anchor[run])


def compare_hashes(blobs: list[bytes], after: int | None = None) -> dict[str, np.ndarray]:
    """From all runs of a bucket, of documents with an id over `after`: id, key, start and end of ranges, with anchor -1 and the id,
    key and start of where a smaller document seems to have the same; or with the anchor, where the bytes have to be
    compared with those of other runs of it (of which those of older documents come along)."""
    anchor, content, windows, run, where, ids, keys = _runs(blobs)
    order = np.lexsort((content, anchor))
    new_anchor = np.append(True, anchor[order][1:] != anchor[order][:-1])
    new_content = new_anchor | np.append(True, content[order][1:] != content[order][:-1])
    of_anchor, of_content = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    of_anchor[order], of_content[order] = np.cumsum(new_anchor) - 1, np.cumsum(new_content) - 1
    low, high = np.full(new_anchor.sum(), np.iinfo(np.int64).max), np.full(new_anchor.sum(), np.iinfo(np.int64).min)
    np.minimum.at(low, of_anchor[run], ids)
    np.maximum.at(high, of_anchor[run], ids)
    differ = np.bincount(np.cumsum(new_anchor)[new_content] - 1, minlength=len(low)) > 1
    fresh = high > (np.iinfo(np.int64).min if after is None else after)
    kept = np.flatnonzero((low < high)[of_anchor[run]] & fresh[of_anchor[run]])
    run, where, ids, keys = run[kept], where[kept], ids[kept], keys[kept]
    group = of_content[run]
    by = np.lexsort((where, keys, ids, group))
    first = by[np.flatnonzero(np.append(True, group[by][1:] != group[by][:-1]))] if len(by) else by
    source = np.zeros(len(of_content) + 1, np.int64)
    source[group[first]] = first
    source = source[group]
    covered = ids[source] < ids
    ask = ~covered & differ[of_anchor[run]]
    if after is not None:
        covered &= ids > after
    keep = covered | ask
    pick = lambda x: x[keep]
    return {
        "id": pick(ids),
        "key": pick(keys),
        "start": pick(where),
        "end": pick(where + windows[run] + WIDTH - 1),
        "anchor": np.where(pick(ask), anchor[run[keep]], -1),
        "from_id": pick(ids[source]),
        "from_key": pick(keys[source]),
        "from_start": pick(where[source]),
    }


def joined_claims(start: np.ndarray, end: np.ndarray, *source: np.ndarray) -> list[np.ndarray]:
    """Claims of one document (start, end, and id, key and start of the source) as few long ones: those that overlap, and have one
    source at one distance, are one."""
    order = np.lexsort((start, source[2] - start, source[1], source[0]))
    start, end, source = start[order], end[order], [x[order] for x in source]
    shift = source[2] - start
    same = (source[0][1:] == source[0][:-1]) & (source[1][1:] == source[1][:-1]) & (shift[1:] == shift[:-1]) & (start[1:] <= end[:-1])
    new = np.append(True, ~same)
    last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)
    return [start[new], end[last], *(x[new] for x in source)]


class Family:
    """Levels of suffix arrays: the distinct windows of earlier batches in the order of their bytes, each with the least document
    that has it; a level is at least twice as large as the next. Batches come in the order of their documents."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, windows: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Takes in a batch (the bytes of each window); for each of its windows, the least document so far."""
        order = np.argsort(docs, kind="stable")
        order = order[np.argsort(windows[order], kind="stable")]  # the batch's suffix array
        sorted_ = windows[order]
        first = np.append(True, sorted_[1:] != sorted_[:-1])
        suffixes, least = sorted_[first], docs[order][first]
        for level, ids in self.levels:
            at = np.minimum(np.searchsorted(level, suffixes), len(level) - 1)
            least = np.where(level[at] == suffixes, np.minimum(ids[at], least), least)
        out = np.empty(len(windows), np.int64)
        out[order] = least[np.cumsum(first) - 1]
        self.levels.append((suffixes, least))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            (w1, d1), (w2, d2) = self.levels.pop(), self.levels.pop()
            w, d = np.concatenate([w2, w1]), np.concatenate([d2, d1])
            order = np.argsort(w, kind="stable")  # two sorted halves, of which the older comes first
            w, d = w[order], d[order]
            at = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            self.levels.append((w[at], np.minimum.reduceat(d, at)))
        return out


def compare_bytes(anchor: np.ndarray, ids: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, from, to): bytes of each run that are covered by windows which also start in a run of its anchor and a smaller document."""
    rank = np.argsort(ids, kind="stable")  # batches in the order of documents
    data = np.frombuffer(b"".join(texts[i] for i in rank), np.uint8)
    size = np.array([len(texts[i]) for i in rank], np.int64)
    ids, begin, windows = ids[rank], np.cumsum(size) - size, size - WIDTH + 1
    at, run = _ranges(begin, windows), np.repeat(np.arange(len(ids)), windows)
    # windows that no other run may have are left out; the screen's hashes decide nothing else
    prints = np.empty(len(at), np.uint64)
    step = np.searchsorted(begin, np.arange(HASHED, len(data) + HASHED, HASHED))
    for a, b in zip([0, *step[:-1]], step, strict=True):
        if b > a:
            part, base = data[begin[a] : begin[b - 1] + size[b - 1]], begin[a]
            x, y = np.searchsorted(run, [a, b])
            prints[x:y] = Spans(part).of(at[x:y] - base, at[x:y] - base + WIDTH)
    order = np.argsort(prints, kind="stable")
    same = prints[order][1:] == prints[order][:-1]
    again = np.zeros(len(at), bool)
    again[order] = np.append(False, same) | np.append(same, False) if len(at) else again
    del prints, order
    some = np.flatnonzero(again)
    family, hit = Family(), np.zeros(len(at), bool)
    whole = np.lib.stride_tricks.sliding_window_view(data, WIDTH) if len(data) >= WIDTH else np.zeros((0, WIDTH), np.uint8)
    a = 0
    while a < len(some):
        b = min(a + BATCH, len(some))
        while b < len(some) and ids[run[some[b]]] == ids[run[some[b - 1]]]:
            b += 1  # a document is not split
        mine = some[a:b]
        least = family.add(np.ascontiguousarray(whole[at[mine]]).view(f"S{WIDTH}").reshape(-1), ids[run[mine]])
        hit[mine] = least < ids[run[mine]]
        a = b
    place = at - begin[run]
    other = run[1:] != run[:-1]
    go = np.flatnonzero(hit & np.append(True, ~hit[:-1] | other)) if len(hit) else np.zeros(0, np.int64)
    stop = np.flatnonzero(hit & np.append(~hit[1:] | other, True)) if len(hit) else go
    return rank[run[go]], place[go], place[stop] + WIDTH


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a union of ranges."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def _lists(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """A column of lists of structs: the row of each element, and the fields."""
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy())), [flat.field(i).to_numpy() for i in range(flat.type.num_fields)]


def _batch(names: list[str], arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names=names)


def _numbered_rows(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """id, key (with the id it stands for the row) and text."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.withColumn("key", F.xxhash64("text"))


def _dealt(long_enough: DataFrame, buckets: int) -> DataFrame:
    """(bucket, blob) of the runs of all documents (id, key, text)."""

    def scan(batches):
        gathered, n = [], 0

        def send():
            got = list(deal(gathered, min(buckets, FANOUT))) if n else []
            gathered.clear()
            return _batch(["bucket", "blob"], [pa.array([b for b, _ in got], pa.int64()), pa.array([x for _, x in got], pa.binary())])

        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for doc, where, windows, anchor, content in slices(data, offsets):
                gathered.append((ids[doc], keys[doc], where.astype(np.uint32), windows.astype(np.uint8), anchor, content))
                n += len(doc)
                if n >= GATHER:
                    yield send()
                    n = 0
        yield send()

    dealt = long_enough.select("id", "key", "text").mapInArrow(scan, "bucket long, blob binary")
    parts = -(-buckets // FANOUT)
    if parts == 1:
        return dealt

    def again(batches):
        now, blobs, size = None, [], 0

        def send():
            got = list(redeal(now, blobs, parts)) if blobs else []
            return _batch(["bucket", "blob"], [pa.array([b for b, _ in got], pa.int64()), pa.array([x for _, x in got], pa.binary())])

        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if blobs and (bucket != now or size > 4 * GATHER):
                    yield send()
                    blobs, size = [], 0
                now, size = bucket, size + len(blob)
                blobs.append(blob)
        yield send()

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(again, "bucket long, blob binary")


def _found(blobs: DataFrame, after: int | None) -> DataFrame:
    """Claims and runs to compare, of all buckets."""

    def by_hash(key: tuple, table: pa.Table) -> pa.Table:
        found = compare_hashes(table.column("blob").to_pylist(), after)
        found["anchor"] = np.where(found["anchor"] < 0, -1, (key[0].as_py() << 32) | found["anchor"])
        return pa.table({k: pa.array(v.astype(np.int32) if k in ("start", "end", "from_start") else v.astype(np.int64)) for k, v in found.items()})

    return blobs.groupBy("bucket").applyInArrow(by_hash, "id long, key long, start int, end int, anchor long, from_id long, from_key long, from_start int")


def _claims(found: DataFrame) -> DataFrame:
    """id, key, start, end, from_id, from_key, from_start: long claims."""
    own = found.where("anchor < 0").groupBy("id", "key").agg(F.collect_list(F.struct("start", "end", "from_id", "from_key", "from_start")).alias("c"))
    names = ["id", "key", "start", "end", "from_id", "from_key", "from_start"]

    def join(batches):
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            row, (start, end, *source) = _lists(batch.column(2))
            out = [[] for _ in names]
            cuts = np.searchsorted(row, np.arange(len(ids) + 1))
            for i in range(len(ids)):
                x, y = cuts[i], cuts[i + 1]
                got = joined_claims(start[x:y].astype(np.int64), end[x:y].astype(np.int64), *(v[x:y].astype(np.int64) for v in source))
                for o, v in zip(out, [np.full(len(got[0]), ids[i]), np.full(len(got[0]), keys[i]), *got], strict=True):
                    o.append(v)
            yield _batch(names, [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out])

    return own.mapInArrow(join, ", ".join(f"{n} long" for n in names))


def _asked(ranges: DataFrame) -> DataFrame:
    """id, key and asked, lists of the (start, end, anchor) that are asked of a document, about ASKED in each."""
    many = durable(ranges.groupBy("id", "key").agg(F.count("*").alias("_n")).where(F.col("_n") > ASKED))
    part = F.lit(0)
    if not many.isEmpty():
        ranges = ranges.join(many, ["id", "key"], "left")
        part = F.pmod(F.xxhash64("start", "end", "anchor"), F.ceil(F.coalesce("_n", F.lit(1)) / ASKED)).cast("int")
    return ranges.groupBy("id", "key", part.alias("_part")).agg(F.collect_list(F.struct("start", "end", "anchor")).alias("asked")).drop("_part")


def _bytes_of(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """id, key, start, end, anchor and bytes of what is asked of documents: a digest where anchor is -1, else the bytes."""

    def read(batches):
        for batch in batches:
            row, (start, end, anchor) = _lists(batch.column(3))
            data, offsets = text_bytes(batch.column(2))
            raw = data.tobytes()
            a, b = (offsets[row] + start).tolist(), (offsets[row] + end).tolist()
            out = [hashlib.blake2b(raw[x:y], digest_size=20).digest() if k < 0 else raw[x:y] for x, y, k in zip(a, b, anchor.tolist(), strict=True)]
            ids, keys = batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row]
            yield _batch(["id", "key", "start", "end", "anchor", "bytes"], [ids, keys, start.astype(np.int64), end.astype(np.int64), anchor.astype(np.int64), pa.array(out, pa.binary())])

    joined = texts.join(asked, ["id", "key"]).select("id", "key", "text", "asked")
    return joined.mapInArrow(read, "id long, key long, start long, end long, anchor long, bytes binary")


def _compared(runs: DataFrame) -> DataFrame:
    """id, key, start, end: what is covered of runs that were compared by their bytes."""
    hot = durable(runs.groupBy("anchor").agg(F.count("*").alias("_n")).where(F.col("_n") > HOT).select("anchor"))
    schema = "id long, key long, start long, end long"

    def by_bytes(table: pa.Table) -> pa.Table:
        anchor, ids, keys, start = (table.column(c).to_numpy() for c in ("anchor", "id", "key", "start"))
        run, a, b = compare_bytes(anchor, ids, table.column("bytes").to_pylist())
        return pa.table({"id": ids[run], "key": keys[run], "start": start[run] + a, "end": start[run] + b})

    cold = runs if hot.isEmpty() else runs.join(hot, "anchor", "left_anti")
    out = cold.withColumn("bucket", F.shiftright("anchor", 32)).groupBy("bucket").applyInArrow(lambda t: by_bytes(t), schema)
    if hot.isEmpty():
        return out

    def windows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                raw, start = batch.column(3)[i].as_py(), batch.column(2)[i].as_py()
                n = len(raw) - WIDTH + 1
                yield _batch(["id", "key", "start", "window"], [np.full(n, batch.column(0)[i].as_py()), np.full(n, batch.column(1)[i].as_py()), np.arange(start, start + n), pa.array([raw[k : k + WIDTH] for k in range(n)], pa.binary())])

    every = runs.join(hot, "anchor").select("id", "key", "start", "bytes").mapInArrow(windows, "id long, key long, start long, window binary")
    least = every.groupBy("window").agg(F.min("id").alias("_low"), F.max("id").alias("_high")).where("_low < _high").drop("_high")
    return out.union(every.join(least, "window").where("id > _low").select("id", "key", "start", (F.col("start") + WIDTH).alias("end")))


def _covered(texts: DataFrame, blobs: DataFrame, after: int | None) -> DataFrame:
    """id, key, start, end of what is covered, of documents with an id over `after`. texts (id, key, text) holds all documents."""
    spark = texts.sparkSession
    found = written(_found(blobs, after))
    let_go(spark)
    claims = written(_claims(found))
    let_go(spark)
    size = F.col("end") - F.col("start")
    ranges = claims.select("id", "key", "start", "end", F.lit(-1).cast("long").alias("anchor"))
    ranges = ranges.union(claims.select("from_id", "from_key", "from_start", F.col("from_start") + size, F.lit(-1).cast("long"))).distinct()
    ranges = ranges.union(found.where("anchor >= 0").select("id", "key", F.col("start").cast("long"), F.col("end").cast("long"), "anchor"))
    said = written(_bytes_of(texts, _asked(ranges)))
    let_go(spark)
    digests = said.where("anchor < 0").select("id", "key", "start", "end", "bytes")
    theirs = digests.select(F.col("id").alias("from_id"), F.col("key").alias("from_key"), F.col("start").alias("from_start"), (F.col("end") - F.col("start")).alias("_size"), F.col("bytes").alias("_theirs"))
    held = claims.withColumn("_size", size).join(digests, ["id", "key", "start", "end"]).join(theirs, ["from_id", "from_key", "from_start", "_size"]).where("bytes = _theirs")
    compared = _compared(said.where("anchor >= 0").select("id", "key", "start", "anchor", "bytes"))
    if after is not None:
        compared = compared.where(F.col("id") > after)
    out = written(held.select("id", "key", "start", "end").union(compared))
    let_go(spark)
    return out


def _cut(rows: DataFrame, covered: DataFrame, id_column: str) -> DataFrame:
    """One row for each row of rows (id, key, text): id_column, n_bytes, n_removed, n_spans and kept."""
    covered = covered.groupBy("id", "key").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def cut(batches):
        for batch in batches:
            out = []
            for i, t, ranges in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw = t.as_py().encode()
                start, end = (np.zeros(0, np.int64),) * 2
                if ranges.is_valid:
                    start, end = merged(*(ranges.values.field(f).to_numpy().astype(np.int64) for f in (0, 1)))
                edges = [0, *np.ravel(np.column_stack([start, end])).tolist(), len(raw)]
                kept = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                out.append((i, len(raw), len(raw) - len(kept), len(start), kept))
            yield _batch([id_column, "n_bytes", "n_removed", "n_spans", "kept"], [pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)])

    joined = rows.join(covered, ["id", "key"], "left").select(F.col("id").alias(id_column), "text", "ranges")
    return joined.mapInArrow(cut, f"{id_column} long, n_bytes long, n_removed long, n_spans long, kept binary")


def _long_enough(rows: DataFrame) -> DataFrame:
    """The documents that have a window, equal rows once."""
    out = rows.where(f"id is not null and octet_length(text) >= {WIDTH}").select("id", "key", "text")
    repeated = out.groupBy("id", "key").agg(F.count("*").alias("_n")).where("_n > 1")
    return out if repeated.isEmpty() else out.dropDuplicates(["id", "key"])


def _bucket_count(rows: DataFrame) -> int:
    return max(16, (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: id_column, n_bytes, n_removed, n_spans and kept, the bytes that are left.

    A byte is removed if a WIDTH-byte string of its document that covers it also starts in a document with a smaller id; all
    strings are judged on the input. Null texts are empty. Rows with one id are none smaller than the other, and equal rows are
    judged once; rows with a null id lose nothing and take nothing from others. Documents under WIDTH bytes stay whole. An empty
    table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = _numbered_rows(docs, id_column, text)
    texts = _long_enough(rows)
    return _cut(rows, _covered(texts, _dealt(texts, _bucket_count(rows)), None), id_column)


class SuffixIndex:
    """Removes repeats from batches of documents as they come, and keeps what it needs of them in a folder that all executors share:
    the texts, and the sorted runs of the batches as levels, of which those of one size are merged. Ids of a batch must be larger
    than all before. buckets: as many as all documents to come will need, at BUCKET bytes each."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self.levels: list[tuple[str, int]] = []
        self.texts: list[str] = []
        self.last: int | None = None

    def save(self) -> str:
        """Writes down which tables the index has; load() goes on from there."""
        rows = [("level", p, n) for p, n in self.levels] + [("texts", p, 0) for p in self.texts] + [("buckets", "", self.buckets)]
        rows += [("last", "", self.last)] if self.last is not None else []
        path = f"{self.folder}/manifest-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, kind string, path string, n long").coalesce(1).write.parquet(path)
        return path

    @classmethod
    def load(cls, spark: SparkSession, folder: str, manifest: str) -> SuffixIndex:
        rows = spark.read.parquet(manifest).orderBy("i").collect()
        of = lambda kind: [r for r in rows if r["kind"] == kind]
        index = cls(spark, folder, of("buckets")[0]["n"])
        index.levels, index.texts = [(r["path"], r["n"]) for r in of("level")], [r["path"] for r in of("texts")]
        index.last = next((r["n"] for r in of("last")), None)
        return index

    def _write(self, df: DataFrame, kind: str) -> str:
        path = f"{self.folder}/{kind}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return path

    def add(self, docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
        """What remove_repeats() gives for a batch, with all batches before it counting as smaller documents."""
        small_batches(self.spark)
        rows = _numbered_rows(docs, id_column, text)
        texts = _long_enough(rows)
        low, high = texts.agg(F.min("id"), F.max("id")).first()
        if low is None:
            return _cut(rows, _covered(texts, _dealt(texts, self.buckets), None), id_column)
        if self.last is not None and low <= self.last:
            raise ValueError(f"a batch must have ids over {self.last}")
        self.texts.append(self._write(texts, "texts"))
        batch = self._write(_dealt(texts, self.buckets), "level")
        blobs = self.spark.read.parquet(*[p for p, _ in self.levels], batch)
        covered = _covered(self.spark.read.parquet(*self.texts), blobs, self.last)
        self.last = high
        self.levels.append((batch, self.spark.read.parquet(batch).agg(F.sum(F.octet_length("blob"))).first()[0] or 0))
        while len(self.levels) > 1 and self.levels[-2][1] < 2 * self.levels[-1][1]:
            (p1, _), (p2, _) = self.levels.pop(), self.levels.pop()
            merged_ = self._write(self._merged(self.spark.read.parquet(p2, p1)), "level")
            self.levels.append((merged_, self.spark.read.parquet(merged_).agg(F.sum(F.octet_length("blob"))).first()[0] or 0))
        return _cut(rows, covered, id_column)

    def _merged(self, blobs: DataFrame) -> DataFrame:
        """The runs of two levels as one, sorted; equal runs are kept once, with all their occurrences."""

        def merge(table: pa.Table) -> pa.Table:
            bucket = table.column("bucket")[0].as_py()
            got = list(redeal(bucket, table.column("blob").to_pylist(), 1))
            return pa.table({"bucket": pa.array([b for b, _ in got], pa.int64()), "blob": pa.array([x for _, x in got], pa.binary())})

        return blobs.groupBy("bucket").applyInArrow(merge, "bucket long, blob binary")
