"""Near-duplicates by consistent weighted sampling of TF-IDF shingles, in bands, verified by weighted Jaccard similarity."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from threadline.llm.components import components, joined
from threadline.durable import durable, let_go, small_batches
from threadline.llm.textbytes import ODD, chunks, mixed, runs, span_hashes, table, text_bytes

WORD = r"[0-9A-Za-z]"
SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 12, 4
#: A shingle in a larger share of the documents weighs less; there are at most (shingles of a document) / RARE such shingles.
RARE = 0.001
#: Bytes of text that a worker takes on at once, and shingles that gather before they are counted.
CHUNK, GATHERED = 1 << 20, 400_000
#: Entries of a sampler's table of random numbers.
TABLE = 1 << 16
#: Partners that one copy of a hot document's text meets.
SALT_PARTNERS = 64
#: Texts that share a shingle with at most so many others are compared with one of them, to join small families early.
FEW = 8


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, times) of the distinct runs of SHINGLE words (fewer, if the text has fewer), sorted by both.

    Words are runs of letters and digits, A-Z lowered; all bytes outside ASCII belong to words.
    """
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    start, end = runs(table(WORD)[data], offsets)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none
    doc = np.searchsorted(offsets, start, "right") - 1
    word = span_hashes(fold[data], start, end)
    del start, end
    n = np.bincount(doc, minlength=len(offsets) - 1)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(doc))  # words from here to the end of the document
    h = np.zeros(len(word), np.uint64)
    for i in range(min(SHINGLE, len(word))):
        part = mixed(word + np.uint64((i + 1) * int(ODD) % (1 << 64)))
        h[: len(h) - i] += np.where(left[: len(h) - i] > i, part[i:], np.uint64(0))
    keep = (left >= SHINGLE) | ((left == n[doc]) & (left < SHINGLE))
    doc, h = doc[keep], mixed(h[keep])
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    doc, h = doc[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


@dataclass
class Weights:
    """Weight of a shingle: times * (1 + idf) / 2, where idf is ln(N / df) over its value for the rarest shingles, 1 at most."""

    frequent: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def of(self, h: np.ndarray, times: np.ndarray) -> np.ndarray:
        out = times.astype(float)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, h), len(self.frequent) - 1)
            out *= np.where(self.frequent[at] == h, (1 + self.idf[at]) / 2, 1.0)
        return out


class Counter:
    """Lossy counting (Manku and Motwani, 2002) of the documents that hold a shingle: what is left out stands in at most
    `share` of the documents seen plus one. New shingles gather until there are GATHERED of them, so that one merge serves many."""

    def __init__(self, share: float):
        self.width = max(1, int(1 / share))
        self.keys, self.counts, self.missed = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.new: list[np.ndarray] = []
        self.gathered = self.seen = self.done = 0

    def add(self, h: np.ndarray, documents: int) -> None:
        """h: the shingles of some documents, each document's once."""
        self.new.append(h)
        self.gathered += len(h)
        self.seen += documents
        if self.gathered >= GATHERED or self.seen // self.width > self.done:
            self.merge()

    def merge(self) -> None:
        """Takes in what has gathered; at the end of a bucket of `width` documents, drops what is too rare."""
        if self.gathered:
            new = np.sort(np.concatenate(self.new))
            self.new, self.gathered = [], 0
            at = np.flatnonzero(np.append(True, new[1:] != new[:-1]))
            new, n = new[at], np.diff(np.append(at, len(new))).astype(np.int32)
            place = np.searchsorted(self.keys, new)
            known = np.zeros(len(new), bool)
            known[place < len(self.keys)] = self.keys[place[place < len(self.keys)]] == new[place < len(self.keys)]
            self.counts[place[known]] += n[known]
            fresh, place = ~known, place[~known]
            self.keys = np.insert(self.keys, place, new[fresh])
            self.counts = np.insert(self.counts, place, n[fresh])
            self.missed = np.insert(self.missed, place, np.int32(self.done))
        if self.seen // self.width > self.done:
            self.done = self.seen // self.width
            self._keep(self.counts + self.missed > self.done)

    def _keep(self, keep: np.ndarray) -> None:
        self.keys, self.counts, self.missed = self.keys[keep], self.counts[keep], self.missed[keep]

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        self._keep(self.counts + self.missed > -(-self.seen // self.width))
        return self.keys, self.counts


def _local_counts(share: float):
    """Shingles that may be frequent in a task's documents, and how often they were seen since they were counted."""

    def run(batches):
        counter = Counter(share)
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                data, offsets = text_bytes(part.column(0))
                counter.add(shingles(data, offsets)[1], len(offsets) - 1)
        keys, counts = counter.found()
        for i in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000].view(np.int64)), pa.array(counts[i : i + 100_000].astype(np.int64))], names=["h", "n"])

    return run


def fit_weights(docs: DataFrame, rare: float = RARE) -> Weights:
    """Exact document frequencies, over all documents, of the shingles in over `rare` of them (and in two at least).

    A first pass finds candidates by lossy counting, a second counts them exactly. Both bring at most 2 / rare shingles for
    each shingle of a mean document to the driver.
    """
    texts = docs.select("text").where("text is not null")
    n = texts.count()
    least = max(1.0, rare * n)
    share = rare / 4
    tasks = max(1, min(texts.rdd.getNumPartitions(), int(n * share)))
    local = texts.coalesce(tasks).mapInArrow(_local_counts(share), "h long, n long")
    error = share * n + tasks
    found = [r["h"] for r in local.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > max(0.0, least - error)).select("h").collect()]
    if not found:
        return Weights()
    wanted = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(found, np.int64).view(np.uint64)))

    def exact(batches):
        keys = wanted.value
        count = np.zeros(len(keys), np.int64)
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                _, h, _ = shingles(*text_bytes(part.column(0)))
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                count += np.bincount(at[keys[at] == h], minlength=len(keys))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(count[some])], names=["h", "n"])

    rows = texts.mapInArrow(exact, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > least).collect()
    wanted.unpersist()
    if not rows:
        return Weights()
    h, df = np.array([r["h"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], float)
    order = np.argsort(h)
    return Weights(h[order], np.clip(np.log(n / df[order]) / math.log(n / least), 0, 1))


class Sampler:
    """Improved consistent weighted sampling (Ioffe, 2010): each sample picks one (shingle, level), and two documents pick the
    same with the probability of their weighted Jaccard similarity. Random numbers come from tables of TABLE entries, read at
    a hash of sample and shingle."""

    def __init__(self, samples: int, seed: int = 11):
        random = np.random.Generator(np.random.PCG64(seed))
        self.r = random.gamma(2, 1, TABLE)
        self.log_c = np.log(random.gamma(2, 1, TABLE))
        self.beta = random.random(TABLE)
        self.seeds = random.integers(1, 1 << 63, samples, dtype=np.uint64)
        self.unit = self.rank(self.log_c - self.r * (1 - self.beta))  # at weight 1 the level is 0

    @staticmethod
    def rank(log_a: np.ndarray) -> np.ndarray:
        """The order of floats, in the high half of 64 bits."""
        bits = log_a.astype(np.float32).view(np.uint32).astype(np.uint64)
        return np.where(bits >> np.uint64(31) > 0, ~bits & np.uint64(0xFFFFFFFF), bits | np.uint64(0x80000000)) << np.uint64(32)

    def of(self, h: np.ndarray, weight: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Samples by documents; at: where each document's shingles begin."""
        out = np.empty((len(self.seeds), len(at)), np.uint64)
        low = h & np.uint64(0xFFFFFFFF)
        odd = np.flatnonzero(weight != 1)
        log_w = np.log(weight[odd])
        for k, seed in enumerate(self.seeds):
            cell = ((h ^ seed) * ODD) >> np.uint64(48)
            value = self.unit[cell] | low
            if len(odd):
                c = cell[odd]
                level = np.floor(log_w / self.r[c] + self.beta[c])
                log_a = self.log_c[c] - self.r[c] * (level - self.beta[c] + 1)
                value[odd] = self.rank(log_a) | ((low[odd] + level.astype(np.int64).astype(np.uint64) * ODD) & np.uint64(0xFFFFFFFF))
            out[k] = np.minimum.reduceat(value, at)
        return out


def band_hashes(data: np.ndarray, offsets: np.ndarray, weights: Weights, sampler: Sampler) -> np.ndarray:
    """BANDS hashes for each text; zeros for texts without words."""
    doc, h, times = shingles(data, offsets)
    out = np.zeros((len(offsets) - 1, BANDS), np.uint64)
    if len(doc):
        at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        samples = sampler.of(h, weights.of(h, times), at)
        for b in range(BANDS):
            band = np.full(len(at), b + 1, np.uint64)
            for row in samples[b * ROWS : (b + 1) * ROWS]:
                band = mixed(band * ODD + row)
            out[doc[at], b] = band
    return out


def signatures(docs: DataFrame, weights: Weights) -> DataFrame:
    """id, text_key and bands (empty for texts without words) of each row with a text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        sampler = Sampler(BANDS * ROWS)
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                bands = band_hashes(*text_bytes(part.column(2)), shared.value, sampler)
                some = bands.any(1)
                offsets = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[some].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["id", "text_key", "bands"])

    return docs.select("id", F.md5(F.col("text").cast("binary")).alias("text_key"), "text").mapInArrow(run, "id long, text_key string, bands array<long>")


def similarities(weights: Weights, first: pa.Array, second: pa.Array, which: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of each text in first with second[which]; texts in second are cut into shingles once."""
    n, m = len(first), len(second)
    a, b = shingles(*text_bytes(first)), shingles(*text_bytes(second))
    wa, wb = weights.of(a[1], a[2]), weights.of(b[1], b[2])
    total = np.bincount(a[0], wa, n) + np.bincount(b[0], wb, m)[which]
    known = np.unique(b[1])
    if not len(known):
        return np.zeros(n)
    keys = b[0] * len(known) + np.searchsorted(known, b[1])  # rising, as shingles are sorted by text and hash
    at = np.minimum(np.searchsorted(known, a[1]), len(known) - 1)
    here = np.flatnonzero(known[at] == a[1])
    wanted = which[a[0][here]] * len(known) + at[here]
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[place] == wanted
    shared = np.bincount(a[0][here][hit], np.minimum(wa[here][hit], wb[place[hit]]), n)
    return np.divide(shared, total - shared, out=np.zeros(n), where=total > shared)


def _pair_chunks(batch: pa.RecordBatch):
    """Slices of a batch of pairs (a, b, text_a, text_b) with about CHUNK bytes of text_a, and of text_b where b changes."""
    b = batch.column(1).to_numpy()
    sizes = [pa.compute.binary_length(batch.column(i)).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3)]
    group = np.cumsum(sizes[0] + sizes[1] * np.append(True, b[1:] != b[:-1])) // CHUNK if len(b) else np.zeros(0, np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(b)]
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        if y > x:
            yield batch.slice(x, y - x)


def _verified(pairs: DataFrame, texts: DataFrame, weights: Weights, similarity: float) -> DataFrame:
    """The pairs (a, b) with at least this similarity. texts (id, text) holds all their ids. Where many pairs share b, its text
    is copied for every SALT_PARTNERS of them, so that no task meets them all."""
    shared = pairs.sparkSession.sparkContext.broadcast(weights)
    copies = pairs.groupBy("b").agg(F.ceil(F.count("*") / SALT_PARTNERS).cast("int").alias("_copies"))
    right = texts.join(copies, texts["id"] == copies["b"]).select("b", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_salt"), F.col("text").alias("text_b"))
    left = pairs.join(copies, "b").withColumn("_salt", F.pmod(F.xxhash64("a"), F.col("_copies")).cast("int"))
    left = left.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(right, ["b", "_salt"]).select("a", "b", "text_a", "text_b")

    def run(batches):
        for batch in batches:
            for part in _pair_chunks(batch):
                _, first, which = np.unique(part.column(1).to_numpy(), return_index=True, return_inverse=True)
                s = similarities(shared.value, part.column(2), part.column(3).take(pa.array(first)), which)
                yield part.select(["a", "b"]).filter(pa.array(s >= similarity - 1e-9))

    out = durable(both.mapInArrow(run, "a long, b long"))
    del both, left, right, copies
    let_go(pairs.sparkSession)
    return out


def _tokens(members: DataFrame, weights: Weights) -> DataFrame:
    """h, id, w: the shingles of each text and their weights."""
    shared = members.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                doc, h, times = shingles(*text_bytes(part.column(1)))
                ids = part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[doc]), pa.array(shared.value.of(h, times))], names=["h", "id", "w"])

    return members.select("id", "text").mapInArrow(run, "h long, id long, w double")


def _open(stars: DataFrame, roots: DataFrame) -> DataFrame:
    """star, id and root of the members of stars of three or more that lie in several components."""
    inside = stars.join(roots, stars["id"] == roots["node"], "left").select("star", "id", F.coalesce("root", "id").alias("root"))
    ends = inside.groupBy("star").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
    return durable(inside.join(durable(ends.where("low <> high and n > 2").select("star")), "star"))


def _across(inside: DataFrame, tokens: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a < b) of one star and different roots that can reach the similarity. inside: star, id, root; tokens of all ids.

    Two texts of different roots share only shingles that occur under more than one root; so a text of weight t, of which c is
    in such shingles, can only be similar to texts of weight similarity * t to (1 + 1 / similarity) * c - t. Texts meet only
    where each is in the other's range, by cells of 5 %. In each meeting place, those of other roots than its commonest meet
    all the others.
    """
    rooted = tokens.join(roots, tokens["id"] == roots["node"], "left").select("h", "id", "w", F.coalesce("root", "id").alias("root"))
    one_root = rooted.groupBy("h", "root").agg(F.sum("w").alias("w")).groupBy("h").agg(F.count("*").alias("n"), F.first("root").alias("root")).where("n = 1").select("h")
    alone = rooted.join(durable(one_root), "h").groupBy("id").agg(F.sum("w").alias("alone"))
    totals = tokens.groupBy("id").agg(F.sum("w").alias("total"))
    bounds = totals.join(alone, "id", "left").select("id", "total", (F.col("total") - F.coalesce("alone", F.lit(0.0))).alias("shared"))
    cell = lambda x: F.floor(F.log(F.greatest(x, F.lit(1e-9))) / math.log(1.05)).cast("long")
    low, high = F.col("total") * similarity * (1 - 1e-9), F.col("shared") * (1 + 1 / similarity) * (1 + 1e-9) - F.col("total")
    ranges = bounds.where(high >= low).select("id", "total", "shared", cell(F.col("total")).alias("own"), cell(low).alias("lo"), cell(high).alias("hi"))
    rows = durable(inside.join(ranges, "id").withColumn("other", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi"))
    place = [F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")]
    rows = rows.select("star", *place, "own", "other", "id", "root", "total", "shared")
    counts = rows.groupBy("star", "p", "q", "root").agg(F.count("*").alias("n"))
    mixed_places = durable(counts.groupBy("star", "p", "q").agg(F.max_by("root", F.struct("n", "root")).alias("common"), F.count("*").alias("roots")).where("roots > 1").drop("roots"))
    rows = durable(rows.join(mixed_places, ["star", "p", "q"]))
    x, y = rows.where("root <> common").alias("x"), rows.alias("y")
    meet = (F.col("x.star") == F.col("y.star")) & (F.col("x.own") == F.col("y.other")) & (F.col("x.other") == F.col("y.own"))
    most = F.least("x.shared", "y.shared")
    able = most * (1 + 1 / similarity) * (1 + 1e-9) >= F.col("x.total") + F.col("y.total")
    both = x.join(y, meet & (F.col("x.root") != F.col("y.root")) & able)
    return both.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _units(docs: DataFrame, weights: Weights) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is compared: unit, text_key, head (the least id with the text) and bands of each distinct text; id and text_key of
    all rows; and pairs (a, b) of units that belong together because one id has both texts.

    A unit is its head, but for the texts of ids that have several, whose units are numbers beyond all ids."""
    members = durable(signatures(docs.where("text is not null and id is not null"), weights))
    rows = members.select("id", "text_key")
    distinct = members.groupBy("text_key").agg(F.min("id").alias("head"), F.first("bands").alias("bands"))
    several = durable(rows.groupBy("id").agg(F.min("text_key").alias("_a"), F.max("text_key").alias("_b")).where("_a <> _b").select("id"))
    if several.isEmpty():
        units = durable(distinct.withColumn("unit", F.col("head")))
        return units, rows, units.select(F.col("unit").alias("a"), F.col("unit").alias("b")).where("false")
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    number = F.monotonically_increasing_id()
    beyond = F.lit(high + 1) + number if high < 1 << 62 else F.lit(low - 1) - number
    marked = distinct.join(several.withColumnRenamed("id", "head").withColumn("_several", F.lit(True)), "head", "left")
    units = durable(marked.withColumn("unit", F.when(F.col("_several"), beyond).otherwise(F.col("head"))).drop("_several"))
    owned = rows.join(several, "id").distinct().join(units.select("text_key", "unit"), "text_key").select("id", "unit")
    least = owned.groupBy("id").agg(F.min("unit").alias("b"))
    return units, rows, durable(owned.join(least, "id").where("unit <> b").select(F.col("unit").alias("a"), "b").distinct())


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: id_column and class_id, the least id of its class.

    Equal texts are one class, whatever their length. Different texts are linked where the weighted Jaccard similarity of their
    TF-IDF shingles of five words is at least `similarity` and they share a band (of 12 bands of 4 samples: 99.8 % of pairs
    at 0.8, more above); classes are the components of the links. In a bucket of texts that share a band, all are compared
    with one of them, which most texts share a bucket with; wherever this leaves these in more than one component, pairs across
    the components are compared as well, but for those that what they share with any other text rules out, so that no link
    that could join classes is lost. Null texts are classes of their own. Texts without words are one class where they are equal.
    Rows that repeat an id are in one class, and so is all that any of their texts is linked with; an empty table gives an
    empty result. Rows with a null id get class_id null.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    weights = fit_weights(docs)
    units, rows, same = _units(docs, weights)
    let_go(spark)
    banded = durable(units.select(F.col("unit").alias("id"), F.explode("bands").alias("band")))
    sizes = durable(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    banded = durable(banded.join(sizes, "band"))
    # the member that the others of a bucket are compared with is the one that most texts share a bucket with
    met = durable(banded.groupBy("id").agg(F.sum("n").alias("met")))
    turn = F.struct("met", (-F.col("id")).alias("_id"), F.col("id").alias("id"))
    buckets = durable(banded.join(met, "id").groupBy("band").agg(F.max(turn)["id"].alias("b")))
    pairs = durable(banded.join(buckets, "band").where("id <> b").select(F.col("id").alias("a"), "b").distinct())
    let_go(spark)
    wanted = pairs.select(F.col("a").alias("unit")).union(buckets.select(F.col("b").alias("unit"))).distinct()
    wanted = units.join(wanted, "unit", "left_semi").select(F.col("unit"), F.col("head").alias("id"), "text_key")
    keyed = docs.where("text is not null and id is not null").withColumn("text_key", F.md5(F.col("text").cast("binary")))
    texts = durable(keyed.join(wanted, ["id", "text_key"]).groupBy("unit").agg(F.first("text").alias("text")).withColumnRenamed("unit", "id"))
    roots = components(_verified(pairs, texts, weights, similarity).union(same))
    let_go(spark)
    # stars of three or more that are not yet one class: first texts that share something rare are compared, then pairs
    # across what components are left, where these may still be similar enough
    seen = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    stars = durable(pairs.select(F.col("b").alias("star"), F.col("a").alias("id")).union(pairs.select("b", "b").distinct()))
    inside = _open(stars, roots)
    if not inside.isEmpty():
        tokens = durable(_tokens(texts.join(inside.select("id").distinct(), "id", "left_semi"), weights))
        rare = durable(tokens.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("a")).where(f"n between 2 and {FEW}").select("h", "a"))
        kin = durable(tokens.join(rare, "h").where("id <> a").select("a", F.col("id").alias("b")).distinct().join(seen, ["a", "b"], "left_anti"))
        roots = joined(roots, _verified(kin, texts, weights, similarity))
        let_go(spark)
        seen = seen.union(kin)
        across = _across(_open(stars, roots), tokens, roots, similarity)
        roots = joined(roots, _verified(durable(across.join(seen, ["a", "b"], "left_anti")), texts, weights, similarity))
    rooted = durable(units.join(roots, units["unit"] == roots["node"], "left").select("text_key", "head", F.coalesce("root", "unit").alias("root")))
    heads = rooted.groupBy("root").agg(F.min("head").alias("class_id"))
    known = rows.join(rooted.join(heads, "root").select("text_key", "class_id"), "text_key").select("id", "class_id")
    rest = docs.where("text is null or id is null").select("id", F.col("id").alias("class_id"))
    mixed_ids = rest.join(rows.select("id").distinct(), "id", "left_semi").isEmpty()
    if not mixed_ids:  # an id with a null text and others
        of_id = known.groupBy("id").agg(F.min("class_id").alias("_class"))
        rest = rest.join(of_id, "id", "left").select("id", F.coalesce("_class", "class_id").alias("class_id"))
    return known.union(rest).withColumnRenamed("id", id_column)


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each class: the one whose doc_id is the class's least. Rows with a null doc_id stay; of rows
    that repeat the least id, the one whose text has the least MD5 stays (a null text counts as empty), and of equal rows one:
    all its texts are one class, so no class is lost. Columns stay as they are; an empty table gives an empty result.
    """
    kept = durable(near_duplicates(docs, similarity).where("doc_id = class_id").select(F.col("doc_id").alias("_id")).distinct())
    let_go(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.struct(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")), F.xxhash64(*docs.columns)).alias("_turn"), F.struct("*").alias("_kept"))
    one = rows.where("_id is not null").join(kept, "_id", "left_semi").groupBy("_id").agg(F.min_by("_kept", "_turn").alias("_kept"))
    return one.select("_kept.*").union(docs.where("doc_id is null"))
