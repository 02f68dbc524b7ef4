"""Quality rules as weak supervision: rules vote or abstain, and expectation-maximisation finds how far to trust each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from threadline.durable import durable, small_batches
from threadline.llm.textbytes import ODD, chunks, mixed, runs, span_hashes, table, text_bytes

WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = b"#*$%&|<>"
#: Words that are hashed in windows at once.
SLICE = 1 << 18
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_marks", "n_ended_lines")


def count_features(batch: pa.RecordBatch) -> np.ndarray:
    """COUNTS of the texts in the batch's only column, a row each."""
    data, offsets = text_bytes(batch.column(0))
    n = len(offsets) - 1
    out = np.zeros((n, len(COUNTS)), np.int64)
    if not len(data):
        return out
    flags = np.zeros((5, 256), bool)
    flags[0] = table(WORD)
    flags[1, list(SYMBOLS)] = True
    flags[2] = table("[A-Za-z]")
    flags[3] = table("[A-Z]") & (np.arange(256) < 128)
    flags[4, list(b"!?")] = True
    sums = lambda mask: np.add.reduceat(np.append(mask, False).view(np.uint8), offsets[:-1], dtype=np.int64) * (np.diff(offsets) > 0)
    inside = flags[0][data]
    head = (data & 0xC0) != 0x80  # bytes that begin a character
    out[:, 1] = sums(inside & head)
    out[:, 2] = sums(flags[1][data])
    out[:, 6] = sums(flags[2][data] & head)
    out[:, 7] = sums(flags[3][data])
    out[:, 8] = sums(flags[4][data])
    start, end = runs(inside, offsets)
    doc = (np.searchsorted(offsets, start, "right") - 1).astype(np.int32)
    out[:, 0] = np.bincount(doc, minlength=n)
    word = np.empty(len(start), np.uint64)
    for a in range(0, len(start), SLICE):
        x, y = start[a : a + SLICE], end[a : a + SLICE]
        word[a : a + SLICE] = span_hashes(data[x[0] : y[-1]], x - x[0], y - x[0])
    del end, inside, head
    if len(word) > 2:
        three = np.empty(len(word) - 2, np.uint64)
        for a in range(0, len(three), SLICE):
            w, d = word[a : a + SLICE + 2], doc[a : a + SLICE + 2][:-2]
            three[a : a + SLICE] = mixed(mixed(mixed(w[:-2]) + w[1:-1]) + w[2:]) ^ mixed(d.astype(np.uint64) * ODD)
        del word
        three = three[doc[2:] == doc[:-2]]
        sorted_ = np.sort(three)
        twice = np.unique(sorted_[1:][sorted_[1:] == sorted_[:-1]])
        del sorted_
        covered, first = np.zeros(len(doc), bool), np.flatnonzero(doc[2:] == doc[:-2])
        for a in range(0, len(three), SLICE) if len(twice) else ():
            t = three[a : a + SLICE]
            again = first[a : a + SLICE][twice[np.minimum(np.searchsorted(twice, t), len(twice) - 1)] == t]
            for i in range(3):
                covered[again + i] = True
        out[:, 4] = np.bincount(doc[covered], minlength=n)
    # lines, of which those with a word count
    a, b = runs(data != 10, offsets)
    line_doc = np.searchsorted(offsets, a, "right") - 1
    keep = np.searchsorted(start, b) > np.searchsorted(start, a)
    a, b, line_doc = a[keep], b[keep], line_doc[keep]
    out[:, 5] = np.bincount(line_doc, minlength=n)
    line = span_hashes(data, a, b) ^ mixed(line_doc.astype(np.uint64) * ODD)
    _, firsts = np.unique(line, return_index=True)
    dup = np.ones(len(line), bool)
    dup[firsts] = False
    out[:, 3] = np.bincount(line_doc[dup], minlength=n)
    ended = np.isin(data[b - 1], list(b".!?:;\"'"))
    out[:, 9] = np.bincount(line_doc[ended], minlength=n)
    return out


def features(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id and COUNTS of every row. Null and empty texts count nothing."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "_text", 1 << 20):
                counts = count_features(part.select(["_text"]))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(counts[:, i]) for i in range(len(COUNTS))]], names=[id_column, *COUNTS])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, F.col(text).alias("_text")).mapInArrow(run, f"{id_column} {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def _vote(ratio: Column, good: Column, bad: Column) -> Column:
    return F.coalesce(F.when(bad, -1).when(good, 1), F.lit(0)).cast("int")


def votes() -> dict[str, Column]:
    """Each rule's vote: 1 for good, -1 for bad, 0 where it abstains."""
    words, lines, letters = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "n_lines", "n_letters"))
    between = lambda x, low, high: (x >= low) & (x <= high)
    length, symbols, dup, repeat = F.col("word_chars") / words, F.col("n_symbols") / words, F.col("n_dup_lines") / lines, F.col("n_repeat_words") / words
    upper, marks, ended = F.col("n_upper") / letters, F.col("n_marks") / words, F.col("n_ended_lines") / lines
    return {
        "word_length": _vote(length, between(length, 4, 8), ~between(length, 3, 10)),
        "symbols": _vote(symbols, symbols <= 0.01, symbols > 0.1),
        "duplicate_lines": _vote(dup, (dup <= 0.05) & (F.col("n_lines") > 2), dup > 0.3),
        "repeats": _vote(repeat, repeat <= 0.2, repeat > 0.5),
        "capitals": _vote(upper, upper <= 0.15, upper > 0.4),
        "exclamations": _vote(marks, marks <= 0.02, marks > 0.15),
        "line_ends": _vote(ended, ended >= 0.5, (ended < 0.1) & (F.col("n_lines") > 2)),
    }


#: Before any row is seen, how often a rule votes -1, 0, 1 on good rows, on rows bad in its own way, and in another way; each
#: counts as BEFORE rows, however many rows there are.
GOOD, OWN, OTHER, BEFORE = (0.02, 0.18, 0.8), (0.7, 0.15, 0.15), (0.1, 0.2, 0.7), 4.0


def posteriors(votes_: np.ndarray, share: np.ndarray, table_: np.ndarray) -> np.ndarray:
    """The probability of each kind, given a row of votes (-1, 0, 1) of each rule."""
    z = np.log(share)[None, :] + np.log(table_[:, np.arange(votes_.shape[1]), votes_ + 1]).sum(2).T
    out = np.exp(z - z.max(1, keepdims=True))
    return out / out.sum(1, keepdims=True)


def fit(patterns: list[tuple[tuple[int, ...], int]], rules: int, known: list[tuple[tuple[int, ...], bool, int]] = (), rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over counted vote patterns: the shares of rows that are good, and bad in each rule's way, and
    how often each rule votes -1, 0, 1 on each of these kinds of rows ((1 + rules) x rules x 3).

    There is a kind of bad rows for each rule, since what one rule finds, others needn't. Votes are independent given the kind.
    known: patterns of labelled rows, whether they are good, and how many; these stay good, or bad in one way or another, and
    so tell what votes alone can't: whether a rule that no other one confirms finds bad rows or accuses good ones. All shares
    are estimated, under Dirichlet priors worth BEFORE rows (1 row for the shares of kinds). Ends when nothing changes any more.
    """
    kinds = 1 + rules
    before = np.empty((kinds, rules, 3))
    before[0], before[1:] = GOOD, OTHER
    before[np.arange(1, kinds), np.arange(rules)] = OWN
    share, table_ = np.full(kinds, 0.1 / max(1, rules)), before.copy()
    share[0] = 0.9
    if not len(patterns) + len(known):
        return share, table_
    rows = [(p, c, True, True) for p, c in patterns] + [(p, c, good, not good) for p, good, c in known]
    v, n = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    may = np.repeat(np.array([r[2:] for r in rows], float), [1, rules], 1)
    # at first a row is bad in the ways that its rules name, and good if none does, as far as its label allows
    part = np.concatenate([(v != -1).all(1, keepdims=True), v == -1], 1) * may
    part = np.where(part.sum(1, keepdims=True) > 0, part, may)
    for turn in range(rounds):
        if turn:
            part = posteriors(v, share, table_) * may + 1e-300 * may
        part = part / part.sum(1, keepdims=True) * n[:, None]
        old = table_.copy()
        share = (part.sum(0) + 1) / (n.sum() + kinds)
        for j in range(rules):
            counts = np.stack([np.bincount(v[:, j] + 1, part[:, k], 3) for k in range(kinds)]) + BEFORE * before[:, j]
            table_[:, j] = counts / counts.sum(1, keepdims=True)
        if turn and np.abs(table_ - old).max() < 1e-7:
            break
    return share, table_


def _known(counted: DataFrame, labels: DataFrame, id_column: str) -> DataFrame:
    """Vote patterns of labelled rows and how many there are; rows of an id are counted before they meet its label."""
    rules = votes()
    own = counted.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("_id"), *[c.alias(k) for k, c in rules.items()]).agg(F.count("*").alias("n"))
    given = labels.where("quality is not null").groupBy(F.col(id_column).alias("_id")).agg(F.min("quality").alias("_low"), F.max("quality").alias("_high")).where("_low = _high")
    return own.join(given, "_id").groupBy(*rules, (F.col("_high") > 0).alias("good")).agg(F.sum("n").alias("n"))


def judge(docs: DataFrame, labels: DataFrame | None = None, id_column: str = "doc_id") -> DataFrame:
    """id, COUNTS, base_failed, posterior (the probability that the row is good) and kept, for every row.

    base_failed: fewer than 50 words, or over half of the words in repeated three-word windows. All others are kept where the
    posterior is 0.5 or more. What votes are worth comes from the votes on all rows, as counts of vote patterns (3 ** rules at most),
    and from the labels (id and quality, 1 for good and 0 for bad) of as many rows as have one; ids with labels of both sorts count
    as unlabelled. Labels never decide a row itself: equal votes give equal posteriors.
    Null and empty texts fail; repeated rows are judged each by itself; long texts take some ten bytes a byte; an empty table gives
    an empty result.
    """
    counted = durable(features(docs, id_column))
    rules = votes()
    voted = counted.select(*[c.alias(k) for k, c in rules.items()])
    patterns = [(tuple(r[k] for k in rules), r["n"]) for r in voted.groupBy(*rules).agg(F.count("*").alias("n")).collect()]
    known = []
    if labels is not None:
        known = sorted((tuple(r[k] for k in rules), r["good"], r["n"]) for r in _known(counted, labels, id_column).collect())
        seen: dict[tuple[int, ...], int] = {}
        for p, _, n in known:
            seen[p] = seen.get(p, 0) + n
        patterns = [(p, n - seen.get(p, 0)) for p, n in patterns if n > seen.get(p, 0)]
    share, table_ = fit(sorted(patterns), len(rules), known)
    # the odds of each kind against good rows, from the rules' votes
    odds = F.lit(0.0)
    for kind in range(1, len(share)):
        z = F.lit(float(np.log(share[kind] / share[0])))
        for c, worth in zip(rules.values(), np.log(table_[kind] / table_[0]).tolist(), strict=True):
            z = z + F.when(c == -1, worth[0]).when(c == 1, worth[2]).otherwise(worth[1])
        odds = odds + F.exp(z)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    out = counted.withColumn("base_failed", failed).withColumn("posterior", 1 / (1 + odds))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
