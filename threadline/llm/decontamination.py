"""Benchmark decontamination: windows of test items, hashed and broadcast, are looked for in every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threadline.durable import durable, written

#: What separates words, once A-Z are lower-cased, and the window's length.
NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The screen has a 64-bit word for each gram, and no more words than this, which bounds what goes to the tasks; beyond it the
#: screen only lets more documents through.
SCREEN_WORDS = 1 << 20
#: Bits that a gram sets in its word of the screen.
SCREEN_BITS = 4


def words(text: Column) -> Column:
    """Normalised words of a text; none for null."""
    # lower() agrees with A-Z lowering on pure ASCII and is faster
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(low, NOT_A_WORD), ""), F.array().cast("array<string>"))


def _hashes(word_hashes: Column, length: int, step: int = 1) -> Column:
    """Hashes of the runs of length words that begin at the first word and every step words on, from the words' own hashes."""
    n = F.size(word_hashes) - length + 1
    one = lambda i: F.xxhash64(F.slice(word_hashes, i, length))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(step)), one)).otherwise(F.array().cast("array<bigint>"))


def _gram(length: int) -> tuple[int, int]:
    """(words, step): every window of length words holds a whole run of so many words that begins at a multiple of step."""
    words = (length + 1) // 2
    return words, length - words + 1


def benchmark_windows(benchmark: DataFrame, text: str = "text", item: str = "item_id", window: int = WINDOW) -> DataFrame:
    """Distinct windows: _length, _words (joined by a space), _hash and _items, the ids (as strings) of the items that hold it.

    An item of fewer words than the window, but not none, is one window. Items without words or without an id are left out.
    """
    rows = benchmark.select(F.col(item).cast("string").alias("_item"), words(F.col(text)).alias("_w")).where("size(_w) > 0 and _item is not null")
    rows = rows.withColumn("_length", F.least(F.size("_w"), F.lit(window)))
    rows = rows.select("_item", "_length", "_w", F.explode(F.sequence(F.lit(1), F.size("_w") - F.col("_length") + 1)).alias("_i"))
    rows = rows.withColumn("_w", F.slice("_w", F.col("_i"), F.col("_length")))
    rows = rows.withColumn("_hash", F.xxhash64(F.transform("_w", lambda w: F.xxhash64(w))))
    return rows.groupBy("_length", F.array_join("_w", " ").alias("_words"), "_hash").agg(F.collect_set("_item").alias("_items"))


def _screen(windows: DataFrame, lengths: list[int]) -> tuple[int, str]:
    """A blocked Bloom filter of the grams of all windows: its words, as the text of a literal array of longs, and their number."""
    grams = None
    for length in lengths:
        own = windows.where(F.col("_length") == length).select(F.explode(_hashes(F.transform(F.split("_words", " "), lambda w: F.xxhash64(w)), _gram(length)[0])).alias("h"))
        grams = own if grams is None else grams.union(own)
    grams = grams.distinct()
    cells = 1 << min(SCREEN_WORDS.bit_length() - 1, max(10, grams.count().bit_length()))
    marks = grams.select(F.col("h").bitwiseAND(F.lit(cells - 1).cast("long")).alias("cell"), _bits(F.col("h")).alias("bits")).groupBy("cell").agg(F.bit_or("bits").alias("bits"))
    found = {r["cell"]: r["bits"] for r in marks.collect()}
    return cells, ",".join(str(found.get(i, 0)) for i in range(cells))


def _bits(h: Column) -> Column:
    """The bits of a hash in its word; the low bits of the hash choose the word."""
    out = None
    for i in range(SCREEN_BITS):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 20 + 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int"))
        out = bit if out is None else out.bitwiseOR(bit)
    return out


def _may_hit(screen: tuple[int, str], word_hashes: Column, lengths: list[int]) -> Column:
    """Whether a document can hold a window: it must hold a gram of one at a multiple of the gram's step."""
    cells, marks = screen
    bitmap = F.split(F.lit(marks), ",").cast("array<bigint>")
    marked = lambda h: F.element_at(bitmap, h.bitwiseAND(F.lit(cells - 1).cast("long")).cast("int") + 1).bitwiseAND(_bits(h)) == _bits(h)
    out = F.lit(False)
    for words_, step in sorted({_gram(length) for length in lengths}):
        out = out | F.exists(_hashes(word_hashes, words_, step), marked)
    return out


def _places(word_hashes: Column, length: int) -> Column:
    return F.transform(_hashes(word_hashes, length), lambda h, i: F.struct((i + 1).alias("at"), F.lit(length).alias("_length"), h.alias("_hash")))


def _judged(docs: DataFrame, benchmark: DataFrame, kept: Column, window: int) -> DataFrame:
    """_kept (as given), _n_words, _hits and _items of each row of docs."""
    windows = durable(benchmark_windows(benchmark, window=window))
    lengths = sorted(r["_length"] for r in windows.select("_length").distinct().collect())
    scan = docs.select(kept.alias("_kept"), F.col("text").alias("_text"), words(F.col("text")).alias("_w"))
    none = [F.array().cast("array<struct<at:int,length:int>>").alias("_hits"), F.array().cast("array<string>").alias("_items")]
    if not lengths:
        return scan.select("_kept", F.size("_w").alias("_n_words"), *none)
    # the partition's number keeps the filters below from being pushed under the hashes, which would be computed for each gram
    scan = scan.select("*", F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"), F.spark_partition_id().alias("_part"))
    may = _may_hit(_screen(windows, lengths), F.col("_h"), lengths)
    clean = scan.where(~may & (F.col("_part") >= 0)).select("_kept", F.size("_w").alias("_n_words"), *none)
    rows = written(scan.where(may & (F.col("_part") >= 0)).select("_kept", "_w", F.md5(F.col("_text").cast("binary")).alias("_key")))
    # copies of a text have the same hits, which are looked for once
    texts = rows.groupBy("_key").agg(F.first("_w").alias("_w")).select("_key", F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    hits = texts.select("_key", F.explode(F.concat(*[_places(F.col("_h"), n) for n in lengths])).alias("_p")).select("_key", "_p.*").join(windows, ["_hash", "_length"])
    hits = hits.groupBy("_key").agg(F.collect_list(F.struct("at", F.col("_length").alias("length"), "_words", "_items")).alias("_found"))
    same = F.filter(F.coalesce("_found", F.array()), lambda x: F.array_join(F.slice("_w", x["at"], x["length"]), " ") == x["_words"])
    found = rows.join(hits, "_key", "left").withColumn("_found", same)
    found = found.select(
        "_kept",
        F.size("_w").alias("_n_words"),
        F.sort_array(F.transform("_found", lambda x: F.struct(x["at"].alias("at"), x["length"].alias("length")))).alias("_hits"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("_found", lambda x: x["_items"])))).alias("_items"),
    )
    return clean.union(found)


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW) -> DataFrame:
    """The columns named in keep, and _n_words, _hits (position and length of the windows found, sorted) and _items (the ids
    of the items found, sorted as strings) of each row of docs.

    A screen rules out most documents: a Bloom filter of all runs of half a window's words, in which only every half window of a
    document is looked up. What it lets through is a few per cent; there all windows are hashed and joined with the benchmark's
    by hash, and hits are compared word by word, so that no collision counts. Spark broadcasts the windows if they are
    small and shuffles otherwise; only texts that pass the screen are ever shuffled. Null texts and texts without words have no
    hits. Each row is judged by itself, repeated ids and texts included; an empty benchmark gives no hits, an empty table no rows.
    """
    return _judged(docs, benchmark, F.struct(*[F.col(f"`{c}`") for c in keep]), window).select("_kept.*", "_n_words", "_hits", "_items")


def words_hit(hits: Column) -> Column:
    """Words that lie in any of the sorted hits."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    end = lambda h: h["at"] + h["length"] - 1
    step = lambda a, h: F.struct(
        (a["n"] + F.greatest(F.lit(0), end(h) - F.greatest(a["end"], h["at"] - 1))).alias("n"), F.greatest(a["end"], end(h)).alias("end")
    )
    return F.aggregate(hits, start, step, lambda a: a["n"]).cast("long")


def is_contaminated(n_words: Column, n_hit: Column) -> Column:
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the documents of which a twentieth of the words or more lies in benchmark windows; columns as they are."""
    judged = _judged(docs, benchmark, F.struct("*"), window)
    return judged.where(~is_contaminated(F.col("_n_words").cast("long"), words_hit(F.col("_hits")))).select("_kept.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs whose text keeps only the normalised words outside the windows found, joined by a space; texts without hits, null ones
    among them, stay as they are. Other columns pass through."""
    judged = _judged(docs, benchmark, F.struct("*"), window)
    inside = lambda i: F.exists("_hits", lambda h: (i + 1 >= h["at"]) & (i + 1 < h["at"] + h["length"]))
    rest = F.array_join(F.filter(words(F.col("_kept.text")), lambda w, i: ~inside(i)), " ")
    text = F.when(F.size("_hits") > 0, rest).otherwise(F.col("_kept.text"))
    return judged.select(*[text.alias(c) if c == "text" else F.col(f"_kept.`{c}`") for c in docs.columns])
