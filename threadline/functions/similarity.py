"""Edit-distance scores as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from threadline.functions.text import split_words

#: Texts longer than this are not slid over each other.
SLIDE_LIMIT = 100


def distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty strings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def reaches(a: Column, b: Column, threshold: float) -> Column:
    """Whether the ratio is the threshold at least; texts whose lengths are too far apart for that are not compared."""
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return (shorter >= threshold * longer - 1e-9) & (ratio(a, b) >= threshold)


def partial_ratio(a: Column, b: Column) -> Column:
    """Best ratio of the shorter string with a slice of its length of the longer; 0 if either is empty, 1 at once if it is contained."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(long) - F.length(short) + 1))
    best = F.array_max(F.transform(starts, lambda i: ratio(short, F.substring(long, i, F.length(short)))))
    return F.when(F.length(short) == 0, F.lit(0.0)).when(F.contains(long, short), F.lit(1.0)).otherwise(best)


def word_alignment(text: Column, reference: Column, threshold: float = 0.7) -> Column:
    """struct(matched, total): greedy, forward only; each reference word takes the best of the next three words of the text."""

    def step(state: Column, word: Column) -> Column:
        ahead = F.transform(F.slice(text, state["at"] + 1, 3), lambda t, i: F.struct(ratio(t, word).alias("r"), (-i).alias("i")))
        best = F.array_max(ahead)
        hit = best.isNotNull() & (best["r"] >= threshold)
        return F.when(hit, F.struct((state["n"] + 1).alias("n"), (state["at"] - best["i"] + 1).alias("at"))).otherwise(state)

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"))
    matched = F.aggregate(reference, start, step, lambda s: s["n"])
    return F.struct(matched.alias("matched"), F.size(reference).alias("total"))


def fragment_score(query: Column, reference: Column) -> Column:
    """For a query that may be part of the reference: the ratio, or a blend with the partial ratio if that is better."""
    q, r = F.size(split_words(query)), F.size(split_words(reference))
    full = ratio(query, reference)
    short = F.least(F.length(query), F.length(reference)) <= SLIDE_LIMIT

    def blend(partial: Column) -> Column:
        return F.when(partial <= full, full).otherwise(F.greatest(full, 0.25 * full + 0.75 * partial * F.least(F.lit(1.0), r / q)))

    sliding = F.element_at(F.transform(F.array(partial_ratio(query, reference)), blend), 1)
    return F.when((q < 2) | (r < 2), F.lit(0.0)).when(~short, full).otherwise(sliding)


def direct_score(query: Column, reference: Column) -> Column:
    """Ratio, or fragment score where the two are close enough or the reference much longer; 0 for empty or missing rows."""
    base = ratio(query, reference)
    nq, nr = F.length(query), F.length(reference)
    several = F.size(split_words(query)) >= 2
    wide = several & (((nq >= 8) & ((base > 0.15) | (nr > 3 * nq))) | ((nq >= 6) & (nq < 8) & (base > 0.15)))
    score = F.when(wide, F.greatest(base, fragment_score(query, reference))).otherwise(base)
    return F.when(F.coalesce(F.length(reference), F.lit(0)) * F.coalesce(nq, F.lit(0)) == 0, F.lit(0.0)).otherwise(score)


def scoped_score(query: Column, reference: Column, bonus: Column) -> Column:
    """Score near a known position, with a bonus for what follows it; at most 1."""
    base = ratio(query, reference)
    wide = (F.size(split_words(query)) >= 2) & (F.length(query) >= 8) & ((base > 0.2) | (F.length(reference) > 3 * F.length(query)))
    return F.least(F.lit(1.0), F.when(wide, F.greatest(base, fragment_score(query, reference))).otherwise(base) + bonus)


def continuation_bonus(group: Column, ordinal: Column, current_group: Column, current_ordinal: Column, current_is_last: Column, first_ordinal: int = 1, bonus: float = 0.22) -> Column:
    """For the next row of the group, and for the next group's first row where the current row is its group's last."""
    following = (group == current_group) & (ordinal == current_ordinal + 1)
    turning = (group == current_group + 1) & (ordinal == first_ordinal) & current_is_last
    return F.when(following | turning, F.lit(bonus)).otherwise(F.lit(0.0))


def best_stem_score(word: Column, query_stems: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(query_stems, lambda q: ratio(q, word))), F.lit(0.0))


def evidence_hits(query_stems: Column, reference_stems: Column, threshold: float = 0.72) -> Column:
    """Query stems used up by reference stems: an exact one, or else the first by name that is close enough."""

    def step(left: Column, r: Column) -> Column:
        close = F.filter(left, lambda q: reaches(q, r, threshold))
        return F.when(F.array_contains(left, r), F.array_remove(left, r)).when(F.size(close) > 0, F.array_remove(left, F.element_at(close, 1))).otherwise(left)

    start = F.array_sort(F.array_distinct(query_stems))
    return F.size(start) - F.aggregate(reference_stems, start, step, F.size)


def has_evidence(query_stems: Column, reference_stems: Column) -> Column:
    return evidence_hits(query_stems, reference_stems) > 0


def distinctive_hits(query_stems: Column, reference_stems: Column, threshold: float = 0.78, generic: tuple[str, ...] = ()) -> Column:
    """Distinct query stems that equal, or nearly, a reference stem; generic ones left out on both sides."""
    keep = lambda s: ~s.isin(*generic) if generic else F.lit(True)
    reference = F.filter(reference_stems, keep)
    return F.size(F.filter(F.array_distinct(F.filter(query_stems, keep)), lambda q: F.exists(reference, lambda r: reaches(q, r, threshold))))


def has_strong_pair(query_stems: Column, reference_stems: Column, threshold: float = 0.78) -> Column:
    """A pair of stems of five letters or more that are equal or nearly so."""
    return F.exists(query_stems, lambda q: F.exists(reference_stems, lambda r: (F.length(q) >= 5) & (F.length(r) >= 5) & reaches(q, r, threshold)))


def has_distinct_target_word(target: Column, window: Column, current: Column, threshold: float = 0.85) -> Column:
    """A word of the target, of four letters or more, that the window has and the current row hasn't."""
    near = lambda words, w: F.exists(words, lambda x: reaches(x, w, threshold))
    return F.exists(target, lambda w: (F.length(w) >= 4) & near(window, w) & ~near(current, w))


def tail_confidence(query_stems: Column, reference_stems: Column) -> Column:
    """How sure it is that the window is near the row's end without its last word; null if it isn't."""
    scores = F.transform(F.slice(reference_stems, F.greatest(F.size(reference_stems) - 3, F.lit(1)), F.lit(4)), lambda r: best_stem_score(r, query_stems))

    def of(scores: Column) -> Column:
        penultimate = F.try_element_at(scores, F.lit(3))
        good = F.filter(scores, lambda s: s >= 0.76)
        average = F.try_divide(F.aggregate(good, F.lit(0.0), lambda a, s: a + s), F.size(good))
        ok = (F.size(reference_stems) >= 5) & (penultimate >= 0.82) & (F.size(good) >= 2)
        return F.when(ok, F.least(F.greatest(0.65 * penultimate + 0.20 * average, F.lit(0.72)), F.lit(0.90)))

    return F.element_at(F.transform(F.array(scores), of), 1)  # scored once


def ending_confidence(query_stems: Column, reference_stems: Column, formula: Column | None = None) -> Column:
    """How sure it is that the window reaches the row's end; null if it doesn't. formula: whether the window is an opening formula
    that the row doesn't have, which ends nothing."""
    last = best_stem_score(F.try_element_at(reference_stems, F.lit(-1)), query_stems)
    before = best_stem_score(F.try_element_at(reference_stems, F.lit(-2)), query_stems)

    def of(p: Column) -> Column:
        sure = F.least(F.greatest(0.75 * p["last"] + 0.20 * p["before"], F.lit(0.70)), F.lit(0.95))
        return F.when(p["last"] >= 0.72, sure).otherwise(tail_confidence(query_stems, reference_stems))

    none = (F.size(reference_stems) == 0) | (F.size(query_stems) == 0) | (F.lit(False) if formula is None else formula)
    return F.when(none, F.lit(None)).otherwise(F.element_at(F.transform(F.array(F.struct(last.alias("last"), before.alias("before"))), of), 1))


def is_covered(alignment: Column, least: float = 0.80) -> Column:
    """Whether so much of a row was heard that the next one can be shown."""
    return (alignment["total"] > 0) & (alignment["matched"] >= least * alignment["total"])


def moves_on(ahead: Column, here: Column, floor: float = 0.32, relaxed: float = 0.28, margin: float = 0.15) -> Column:
    """Whether the score of the row ahead is enough for a move on weak evidence."""
    return (ahead >= floor) | ((ahead >= relaxed) & (ahead >= here + margin))


def counts_as_fragment(base: Column, query: Column, query_stems: Column, reference_stems: Column) -> Column:
    """Whether a query of three words may be part of a span: by a good ratio, or evidence."""
    return (F.size(split_words(query)) >= 3) & ((base >= 0.34) | ((F.size(query_stems) >= 2) & has_evidence(query_stems, reference_stems)))


def counts_as_entry_fragment(base: Column, query: Column, query_stems: Column, reference_stems: Column) -> Column:
    """The same for a single row, which asks for more."""
    return (F.size(split_words(query)) >= 3) & ((base >= 0.45) | (evidence_hits(query_stems, reference_stems) >= 2))


def clamp(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
