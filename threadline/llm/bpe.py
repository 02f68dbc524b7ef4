"""Byte-pair encoding of a corpus through a table of its distinct words, and decoding.

Texts are cut at white space into blocks of many documents. A block keeps its texts as numbers of its own distinct words; the words
themselves go, by a hash, to buckets, where those of all blocks meet and each is encoded once. The ids come back to the
blocks, a pack for each (block, bucket), and are put in place by number.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from threadline.durable import small_batches, written_by
from threadline.llm.textbytes import span_hashes, text_bytes

#: Bytes of text in a block, of text for each bucket of words, and of text that is given out at once.
BLOCK, BUCKET, OUT = 16 << 20, 8 << 20, 4 << 20
#: Words that the tokenizer is given at once.
WORDS = 2048


def _loaded(tokenizer: str):
    return _loaded_once(tokenizer)


@functools.lru_cache(maxsize=2)
def _loaded_once(tokenizer: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_str(tokenizer)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def load(path: str) -> str:
    """A tokenizer's file as text, to be sent to the executors. ValueError where its words depend on white space or on each other, or where it
    decodes by more than joining pieces: these need the whole text."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    spec, tokenizer = json.loads(text), _loaded(text)
    ids = lambda s: tokenizer.encode(s, add_special_tokens=False).ids
    spaces = " \t\n\v\f\r"
    apart = all(not ids(s) and ids(f"ab{s}cd") == ids("ab") + ids("cd") and ids(f"{s}ab{s}{s}") == ids("ab") for s in spaces)
    if not apart or spec.get("decoder") or any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(s in t["content"] for s in spaces) for t in spec["added_tokens"]):
        raise ValueError("this tokenizer doesn't take texts word by word, or decodes by more than joining pieces")
    return text


def pieces(tokenizer: str) -> pa.Array:
    """The id-to-piece table: a piece for each id, null where an id is free."""
    loaded = _loaded(tokenizer)
    names = loaded.get_vocab(with_added_tokens=True)
    out: list[str | None] = [None] * (max(names.values(), default=-1) + 1)
    for piece, i in names.items():
        out[i] = piece
    return pa.array(out, pa.large_string())


def _packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte of equal weight, compressed; small numbers take little room."""
    numbers = np.ascontiguousarray(numbers, "<u4")
    planes = numbers.view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(numbers).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, np.uint32)
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, "zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _packed_words(words: pa.Array) -> list[bytes]:
    data, at = text_bytes(words)
    return [_packed(np.diff(at)), len(data).to_bytes(8, "little") + pa.compress(data.tobytes(), "zstd", asbytes=True)]


def _unpacked_words(sizes: bytes, data: bytes) -> pa.Array:
    at = np.append(0, np.cumsum(_unpacked(sizes), dtype=np.int64))
    plain = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd")
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), plain)


def _cut(kept: pa.Array, texts: pa.Array, block: int, buckets: int):
    """A block's rows for _blocks: one with its documents (bucket -1), and one with the words of each bucket."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    values, offsets = split.flatten(), np.asarray(split.offsets, np.int64)
    full = pc.greater(pc.binary_length(values), 0)
    counts = np.diff(np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))[offsets - offsets[0]])
    coded = values.filter(full).dictionary_encode()
    words, codes = coded.dictionary.cast(pa.string()), coded.indices.to_numpy(zero_copy_only=False)
    del split, values, full, coded
    times = np.bincount(codes, minlength=len(words))
    by_times = np.argsort(-times, kind="stable")  # frequent words get small numbers
    number = np.empty(len(words), np.uint32)
    number[by_times] = np.arange(len(words), dtype=np.uint32)
    data, at = text_bytes(words)
    bucket = (span_hashes(data, at[:-1], at[1:]) % np.uint64(buckets)).astype(np.int64) if len(words) else np.zeros(0, np.int64)
    bucket = bucket[by_times]
    yield block, -1, kept, [_packed(counts), _packed(number[codes]), _packed(bucket)]
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    words = words.take(pa.array(by_times[order]))
    for b in np.flatnonzero(np.diff(edges)):
        yield block, int(b), kept[:0], _packed_words(words[edges[b] : edges[b + 1]])


def _schema(kept: T.DataType) -> T.StructType:
    """block; bucket, -1 for a block's documents; those; packs: of the documents' words, or of the bucket's."""
    fields = {"block": T.LongType(), "bucket": T.IntegerType(), "kept": T.ArrayType(kept), "packs": T.ArrayType(T.BinaryType())}
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def _row(block: int, bucket: int, kept: pa.Array, packs: list[bytes]) -> pa.RecordBatch:
    kept = pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept)
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), kept, pa.array([packs], pa.list_(pa.binary()))], names=["block", "bucket", "kept", "packs"])


def _blocks(rows: DataFrame, buckets: int, size: int) -> DataFrame:
    """rows (_kept, _text) in blocks of about `size` bytes of text."""

    def run(batches):
        from pyspark import TaskContext

        task, n, have, held = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            table = pa.Table.from_batches(have).combine_chunks()
            column = lambda i: table.column(i).chunk(0) if table.num_rows else None
            for made in _cut(column(0), column(1), (task << 32) + n, buckets):
                yield _row(*made)

        for batch in batches:
            if not batch.num_rows:
                continue
            have.append(batch)
            held += batch.column(1).nbytes
            if held >= size:
                yield from flush()
                n, have, held = n + 1, [], 0
        if have:
            yield from flush()

    return rows.mapInArrow(run, _schema(rows.schema["_kept"].dataType))


def _encoded(blocks: DataFrame, tokenizer: str) -> DataFrame:
    """For each row of words: its block and bucket, with the packed numbers of ids, and ids, of its words. Each distinct word is encoded once."""

    def run(group: pa.Table) -> pa.Table:
        loaded = _loaded(tokenizer)
        lists = [_unpacked_words(*x) for x in group.column("packs").to_pylist()]
        coded = pa.concat_arrays(lists).dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        sizes, ids = [], []
        for a in range(0, len(words), WORDS):
            for e in loaded.encode_batch(words[a : a + WORDS].to_pylist(), add_special_tokens=False):
                sizes.append(len(e.ids))
                ids.extend(e.ids)
        sizes, ids = np.array(sizes, np.int64), np.array(ids, np.uint32)
        first, edges = np.cumsum(sizes) - sizes, np.append(0, np.cumsum([len(x) for x in lists]))
        packs = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = codes[a:b]
            packs.append([_packed(sizes[own]), _packed(ids[_spread(first[own], sizes[own])])])
        return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "packs": pa.array(packs, pa.list_(pa.binary()))})

    of = blocks.where("bucket >= 0").select("block", "bucket", "packs")
    return of.groupBy("bucket").applyInArrow(run, "block long, bucket int, packs array<binary>")


def _spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions first, first + 1, ... of each range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + sizes, sizes)


def _put_back(blocks: DataFrame, packs: DataFrame, tokenizer: str, decoded: bool) -> DataFrame:
    """Documents with their ids, and decoded texts if asked for. Blocks are stored by number, so they don't travel: the packs come to them."""
    kind = blocks.schema["kept"].dataType.elementType
    fields = [T.StructField("_kept", kind), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]

    def run(batches):
        table = pieces(tokenizer) if decoded else None

        def whole(kept, own, sizes, ids):
            counts, codes, bucket = map(_unpacked, own)
            order = np.argsort(bucket, kind="stable")
            size, flat = (np.concatenate(x) if x else np.zeros(0, np.uint32) for x in (sizes, ids))
            starts = np.cumsum(size, dtype=np.int64) - size
            at, many = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
            at[order], many[order] = starts, size
            ends = np.append(0, np.cumsum(counts, dtype=np.int64))
            a = 0
            while a < len(counts):  # about OUT bytes at once, a document at least
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + OUT // 8, "right")) - 1)
                part = codes[ends[a] : ends[b]]
                out = flat[_spread(at[part], many[part])].astype("<u4")
                edges = np.append(0, np.cumsum(many[part]))[ends[a : b + 1] - ends[a]]
                binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((edges * 4).astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())
                text = pa.nulls(b - a, pa.string())
                if decoded:
                    text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(edges), table.take(pa.array(out))), pa.scalar(" ", pa.large_string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([kept[a:b], binary, text], names=["_kept", "ids", "decoded"])
                a = b

        for batch in batches:
            for i in range(batch.num_rows):
                packs = batch.column(2)[i].as_py() or []
                yield from whole(batch.column(0)[i].values, batch.column(1)[i].as_py(), [_unpacked(x["packs"][0]) for x in packs], [_unpacked(x["packs"][1]) for x in packs])

    gathered = packs.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "packs"))).alias("coded"))
    both = blocks.where("bucket < 0").select("block", "kept", "packs").join(gathered.hint("merge"), "block", "left").select("kept", "packs", "coded")
    return both.mapInArrow(run, T.StructType(fields))


def encode(docs: DataFrame, path: str, text: str = "text", decoded: bool = False, keep: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """docs (or the columns in keep) with ids, as 32-bit little-endian numbers one after the other, and with decoded: the text of these ids.

    The same ids as the tokenizer in the file at path gives for each whole text without special tokens around it; `decoded` joins
    the pieces of all ids by the table of pieces, by position, as decode() does. Null and empty texts have no ids and an empty
    decoded text; rows that repeat an id or a text are taken each by itself; a text of any length stays in one block, which takes
    some ten bytes a byte; an empty table gives an empty one. Columns named ids or decoded are replaced. The driver reads the
    tokenizer's file, and sends it; its size is that of the vocabulary, whatever the corpus.
    """
    tokenizer = load(path)
    small_batches(docs.sparkSession)
    names = [c for c in (keep or docs.columns) if c not in ("ids", "decoded")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_kept"), F.col(text).alias("_text"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = written_by(_blocks(rows, max(16, min(1 << 30, -(-size // BUCKET))), block), "block")
    out = _put_back(blocks, _encoded(blocks, tokenizer), tokenizer, decoded)
    return out.select("_kept.*", "ids", *(["decoded"] if decoded else []))


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """encoded with decoded, the pieces of its ids joined by spaces. ids is binary, as encode() gives it.

    A join of every id with the id-to-piece table, which is broadcast as it is as large as the vocabulary; unknown ids have no
    piece. Null ids give null, empty ones an empty text. A column named decoded is replaced.
    """
    tokenizer = load(path)
    small_batches(encoded.sparkSession)
    rows = encoded.drop("decoded").select(F.struct("*").alias("_kept"), F.col(ids).alias("_ids"))

    def run(batches):
        table = pieces(tokenizer)
        for batch in batches:
            lists = batch.column(1)
            flat = np.frombuffer(b"".join(x.as_py() or b"" for x in lists), "<u4")
            edges = np.append(0, np.cumsum(np.array([len(x.as_py() or b"") // 4 for x in lists], np.int64)))
            known = flat < len(table)
            names = table.take(pa.array(np.where(known, flat, 0)))
            known &= np.asarray(pc.is_valid(names).to_numpy(zero_copy_only=False), bool)
            edges = np.append(0, np.cumsum(known))[edges]
            joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(edges), names.filter(pa.array(known))), pa.scalar(" ", pa.large_string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(pc.is_valid(lists), joined, pa.scalar(None, pa.string()))], names=["_kept", "decoded"])

    return rows.mapInArrow(run, T.StructType([rows.schema["_kept"], T.StructField("decoded", T.StringType())])).select("_kept.*", "decoded")
