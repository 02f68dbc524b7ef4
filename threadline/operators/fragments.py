"""Where short texts lie in long ones, with errors, without sliding each over all of each.

A needle that lies in a text with k errors is cut into k + 3 segments: three of them stand unchanged in the text, each at most k letters
from its place. All segments of a block of needles are looked up in one pass over a text, and only the slices around what is
found are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from threadline.durable import small_batches
from threadline.functions.distance import best_slice

#: Bytes of needles that are looked up in one pass over the texts.
BLOCK = 2 << 20
#: Segments more than errors: so many besides the one must be found unchanged, near each other's place.
SPARE = 2


def segments(needle: str, errors: int) -> list[tuple[int, str]]:
    """(start, text) of errors + 1 + SPARE pieces, as even as can be; of fewer, a letter each, where the needle is too short."""
    n = min(errors + 1 + SPARE, len(needle))
    cuts = [i * len(needle) // n for i in range(n + 1)]
    return [(a, needle[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def allowed(length: int, least: float) -> int:
    """The errors of a needle of that length whose ratio reaches `least`."""
    errors = int((1 - least) * length + 1e-9)
    return errors - (1 - errors / length < least)


class Needles:
    """The segments of some needles, to be looked up at once."""

    def __init__(self, needles: list[tuple[int, str]], least: float):
        self.needles = needles
        self.errors = [allowed(len(t), least) for _, t in needles]
        self.pieces: list[int] = []
        self.masks: list[dict[str, int]] = []
        places: dict[str, list[tuple[int, int]]] = {}
        for i, (_, t) in enumerate(needles):
            cut, masks = segments(t, self.errors[i]), {}
            for start, piece in cut:
                places.setdefault(piece, []).append((i, start))
            for at, c in enumerate(t):
                masks[c] = masks.get(c, 0) | 1 << at
            self.pieces.append(len(cut))
            self.masks.append(masks)
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, (len(piece), at))
        if places:
            self.automaton.make_automaton()
        self.any = bool(places)

    def starts(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """For each needle that may lie in the text, the ranges (first, last) of where it can start, merged."""
        found: dict[int, list[int]] = {}
        for end, (size, at) in self.automaton.iter(text) if self.any else ():
            for i, start in at:
                found.setdefault(i, []).append(end + 1 - size - start)
        out = {}
        for i, places in found.items():
            k, last, ranges = self.errors[i], len(text) - len(self.needles[i][1]), []
            more = self.pieces[i] - k - 1  # segments that stand unchanged, besides the first of them
            places.sort()
            for p, q in zip(places, places[more:], strict=False):
                a, b = max(0, q - k), min(last, p + k)
                if a > b:
                    continue
                if ranges and a <= ranges[-1][1] + 1:
                    ranges[-1][1] = max(ranges[-1][1], b)
                else:
                    ranges.append([a, b])
            ranges = [(a, b) for a, b in ranges if self._may(i, text[a : b + len(self.needles[i][1])])]
            if ranges:
                out[i] = ranges
        return out

    def _may(self, i: int, text: str) -> bool:
        """Whether some slice of the text, of any length, is as near to the needle as wanted (bit-parallel, a whole number for all rows)."""
        masks, m, most = self.masks[i], len(self.needles[i][1]), self.errors[i]
        ones, top, up, down, score = (1 << m) - 1, 1 << (m - 1), (1 << m) - 1, 0, m
        for c in text:
            eq = masks.get(c, 0)
            xh = ((((eq & up) + up) ^ up) | eq) & ones
            ph, mh = down | (ones & ~(xh | up)), up & xh
            score += bool(ph & top) - bool(mh & top)
            if score <= most:
                return True
            xv, ph, mh = eq | down, (ph << 1) & ones, (mh << 1) & ones
            up, down = mh | (ones & ~(xv | ph)), ph & xv
        return False

    def matches(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(needle, errors, start) of each needle that lies in the text: with the fewest errors, and of these the first."""
        for i, ranges in self.starts(text).items():
            errors, start = best_slice(self.needles[i][1], text, ranges)
            if errors <= self.errors[i]:
                yield i, errors, start


def _blocks(needles: DataFrame) -> list[list[tuple[int, str]]]:
    """The needles in blocks of BLOCK bytes."""
    out, held = [[]], 0
    for r in needles.toLocalIterator():
        if held > BLOCK:
            out.append([])
            held = 0
        out[-1].append((r["needle_id"], r["text"]))
        held += 4 * len(r["text"])
    return out


def find_fragments(needles: DataFrame, texts: DataFrame, least: float = 0.9, id_column: str = "row_id") -> DataFrame:
    """needle_id, the text's id, ratio and start (from 0) of each needle in each text of which a slice as long as the needle has a ratio of
    `least` or more with it: the best slice, and of equals the first. The same as sliding each needle over each text.

    needles: needle_id (long) and text; texts: the id and text. Texts shorter than a needle don't have it; null and empty ones
    have none and are none. Rows of both sides that repeat count each by itself; 0.5 <= least <= 1. Needles are read block by
    block, each of a bounded size, and each block is one pass over the texts, whatever their length or number; what a pass
    keeps for a text grows with what is found in it. Empty tables give an empty one.
    """
    if not 0.5 <= least <= 1:
        raise ValueError("least must be between 0.5 and 1")
    small_batches(texts.sparkSession)
    wanted = needles.select(F.col("needle_id").cast("long").alias("needle_id"), "text").where("text <> ''")
    rows = texts.select(F.col(id_column), F.col("text"))
    schema = T.StructType([T.StructField("needle_id", T.LongType()), rows.schema[id_column], T.StructField("ratio", T.DoubleType()), T.StructField("start", T.IntegerType())])

    def looked_up(block: list[tuple[int, str]]) -> DataFrame:
        def run(batches):
            own = Needles(block, least)
            for batch in batches:
                found = [(i, j, e, s) for j, t in enumerate(batch.column(1).to_pylist()) if t for i, e, s in own.matches(t)]
                i, j, e, s = np.array(found, np.int64).reshape(-1, 4).T
                sizes = np.array([len(own.needles[x][1]) for x in i], np.int64)
                ids = pa.array([own.needles[x][0] for x in i], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, batch.column(0).take(pa.array(j)), pa.array(1 - e / np.maximum(sizes, 1)), pa.array(s.astype(np.int32))], names=schema.names)

        return rows.mapInArrow(run, schema)

    out = None
    for block in _blocks(wanted):
        part = looked_up(block)
        out = part if out is None else out.union(part)
    return out
