"""Language identification by cross-parsing: the language whose training text covers a text in the fewest phrases wins."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from threadline.durable import small_batches
from threadline.llm.ordering import shuffle_key
from threadline.llm.textbytes import chunks, text_bytes

#: The training sample: documents of each language and of all together, characters of a document (a random window of longer
#: ones), symbols of each language, and languages (those with the most documents).
SAMPLE_DOCS, SAMPLE_ALL, SAMPLE_CHARS, SAMPLE_SYMBOLS, MOST_LANGUAGES = 200, 20_000, 10_000, 30_000, 1000
#: Symbols of all languages together, which bounds the automata to about 400 bytes each; with many languages each gets less.
ALL_SYMBOLS = 600_000
LANE = 256
UNDECIDED = "und"


@dataclass
class Model:
    """symbol: of each byte (0: between words). tables: each language's automaton, completed: at state s, symbol c, table[s + c]
    holds twice the next state plus whether a phrase has ended; a state is the place of its row."""

    languages: list[str]
    symbol: np.ndarray
    tables: list[np.ndarray]
    lengths: list[int]

    def __getstate__(self) -> dict:
        """Tables packed: most entries repeat the first state's row, and every executor keeps a broadcast on its disk."""
        return self.__dict__ | {"tables": [zlib.compress(t.tobytes(), 1) for t in self.tables]}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state | {"tables": [np.frombuffer(zlib.decompress(t), np.int32) for t in state["tables"]]}


def symbols(data: np.ndarray, offsets: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as symbols, with one 0 for each run of bytes that aren't of words; and their offsets."""
    s = symbol[data]
    keep = s != 0
    keep[1:] |= s[:-1] != 0
    total = np.concatenate([[0], np.cumsum(keep)])
    return s[keep], total[offsets]


def suffix_automaton(text: np.ndarray, alphabet: int) -> np.ndarray:
    """Transitions of the automaton of all substrings of text, a row of states by symbols; -1 where there is none."""
    following: list[dict[int, int]] = [{}]
    length, link = [0], [-1]
    last = 0
    for c in text.tolist():
        new = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in following[p]:
            following[p][c] = new
            p = link[p]
        if p != -1:
            q = following[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and following[p].get(c) == q:
                    following[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    out = np.full((len(following), alphabet), -1, np.int32)
    for i, row in enumerate(following):
        for c, to in row.items():
            out[i, c] = to
    return out


def completed(automaton: np.ndarray) -> np.ndarray:
    """The automaton for whole texts: where a match can't go on, a phrase ends and the symbol begins the next."""
    alphabet = automaton.shape[1]
    on = automaton >= 0
    to = np.where(on, automaton, np.maximum(automaton[0], 0)[None, :])
    return (to * np.int32(2 * alphabet) + ~on).astype(np.int32).reshape(-1)


def train(labelled: DataFrame, seed: int = 7) -> Model:
    """From labelled rows (doc_id, text, lang): all languages, each learned from a bounded random sample of its documents.

    Rows without a text or a language teach nothing. Rows that repeat both id and text count once, so that one document can't
    fill the sample; a null id is an id like others. Of long documents a random window is taken. An empty table gives a model
    without languages, which leaves every text undecided.
    """
    usable = labelled.where("lang is not null and text is not null")
    usable = usable.select("lang", "text", F.md5(F.concat(shuffle_key(seed, "doc_id"), F.xxhash64("text").cast("string")).cast("binary")).alias("_key"))
    known = [r["lang"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()]
    if not known:
        return build({})
    usable = usable.where(F.col("lang").isin(known))
    each = max(1, min(SAMPLE_DOCS, SAMPLE_ALL // len(known)))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("_key"))
    chosen = usable.groupBy("lang", "_key").agg(F.lit(1).alias("_one")).withColumn("_n", first).where(F.col("_n") <= each).select("lang", "_key")
    start = F.pmod(F.xxhash64("_key"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1) + 1
    texts = usable.join(F.broadcast(chosen), ["lang", "_key"]).select("lang", "_key", F.substring("text", start.cast("int"), F.lit(SAMPLE_CHARS)).alias("text"))
    by_language: dict[str, list[bytes]] = {}
    for r in sorted(texts.groupBy("lang", "_key").agg(F.min("text").alias("text")).collect()):
        by_language.setdefault(r["lang"], []).append(r["text"].encode())
    return build(by_language)


def _shares(sizes: list[int], budget: int) -> list[int]:
    """What each of some documents gives to a budget: equal shares, where short ones give all they have."""
    out, left = [0] * len(sizes), budget
    for done, i in enumerate(sorted(range(len(sizes)), key=lambda i: sizes[i])):
        out[i] = min(sizes[i], left // (len(sizes) - done))
        left -= out[i]
    return out


def build(texts: dict[str, list[bytes]]) -> Model:
    """A model from each language's texts, of which each gives an equal share of the symbols."""
    most = min(SAMPLE_SYMBOLS, ALL_SYMBOLS // max(1, len(texts)))
    seen = np.unique(np.frombuffer(b"".join(t for ts in texts.values() for t in ts), np.uint8))
    symbol = np.zeros(256, np.uint8)
    symbol[97:123] = np.arange(1, 27)
    symbol[65:91] = np.arange(1, 27)
    high = seen[seen >= 128]
    symbol[128:] = 27  # never seen
    symbol[high] = 28 + np.arange(len(high))
    alphabet = 28 + len(high)
    tables, lengths = [], []
    for lang in sorted(texts):
        parts = [symbols(np.frombuffer(t + b"\n", np.uint8), np.array([0, len(t) + 1]), symbol)[0] for t in texts[lang]]
        s = np.concatenate([p[:n] for p, n in zip(parts, _shares([len(p) for p in parts], most), strict=True)])
        tables.append(completed(suffix_automaton(s, alphabet)))
        lengths.append(max(2, len(s)))
    return Model(sorted(texts), symbol, tables, lengths)


def phrases(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised phrase counts, a row for each text and a column for each language, and the texts' lengths in symbols.

    Texts are parsed in lanes of LANE symbols side by side, each of which starts a phrase; all of every text is parsed.
    """
    n = len(offsets) - 1
    s, at = symbols(data, offsets, model.symbol)
    sizes = np.diff(at)
    lanes = -(-sizes // LANE)
    out = np.zeros((n, len(model.languages)))
    if not len(s):
        return out, sizes
    doc = np.repeat(np.arange(n), lanes)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    begin = at[doc] + first * LANE
    end = np.minimum(begin + LANE, at[doc + 1])
    order = np.argsort(begin - end, kind="stable")  # long lanes first, so that those still running are a prefix
    begin, end, doc = begin[order], end[order], doc[order]
    running = np.searchsorted(-(end - begin), -np.arange(LANE), "left")
    columns = [s[begin[:k] + i] for i, k in enumerate(running)]
    for j, (step, length) in enumerate(zip(model.tables, model.lengths, strict=True)):
        state = np.zeros(len(doc), np.int32)
        count = np.ones(len(doc), np.int32)
        for c, k in zip(columns, running, strict=True):
            v = step[state[:k] + c]
            count[:k] += v & 1
            state[:k] = v >> 1
        out[:, j] = np.bincount(doc, weights=count, minlength=n) * np.log2(length)
    return out / np.maximum(sizes, 1)[:, None], sizes


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score.

    lang_pred: the language with the fewest phrases per symbol, each weighed by the logarithm of its training length; of equals the first by name.
    score: by how much of the second's phrases the winner needs fewer (1 if there is but one language). Texts that are null or
    have no letter are `und` with score 0. Columns of these two names are replaced, all others pass through. Every row is judged by itself; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(column: pa.Array, letters: pa.Array) -> tuple[list[str], np.ndarray]:
        m = shared.value
        data, offsets = text_bytes(column)
        per, _ = phrases(m, data, offsets)
        ok = letters.to_numpy(zero_copy_only=False).astype(bool)
        if not m.languages:
            return [UNDECIDED] * len(ok), np.zeros(len(ok))
        best = per.argmin(1)
        two = np.sort(per, 1)
        score = np.where(two[:, 1] > 0, 1 - two[:, 0] / np.maximum(two[:, 1], 1e-300), 0) if per.shape[1] > 1 else np.ones(len(ok))
        return [m.languages[b] if k else UNDECIDED for b, k in zip(best, ok, strict=True)], np.where(ok, np.clip(score, 0, 1), 0.0)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, text):
                lang, score = judge(part.column(part.schema.get_field_index(text)), part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*part.schema.names[:-1], "lang_pred", "score"])

    docs = docs.drop("lang_pred", "score")
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letters")
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return docs.select("*", letter).mapInArrow(run, schema)


def keep_languages(docs: DataFrame, model: Model, wanted: list[str] | None = None) -> DataFrame:
    """docs in one of the wanted languages, or in any that the model knows; undecided texts go. Columns stay as they are, whatever
    their names. Every row is judged by itself; an empty table gives an empty result."""
    ok = F.col("lang_pred") != UNDECIDED if wanted is None else F.col("lang_pred").isin(wanted)
    if not {"lang_pred", "score", "_letters"} & set(docs.columns):
        return identify(docs, model).where(ok).select(*[F.col(f"`{c}`") for c in docs.columns])
    judged = identify(docs.select(F.struct("*").alias("_kept"), F.col("text").alias("_text")), model, "_text")
    return judged.where(ok).select("_kept.*")


def held_out(id_column: str = "doc_id") -> Column:
    """Documents that are never learned from; among them those without an id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(True))
