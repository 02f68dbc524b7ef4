"""Normalising, word and stem functions as columns. A profile holds what depends on the language."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Profile:
    """marks: a character class that is dropped. source and target: characters that are folded. lower: fold case first.
    prefixes: (prefix, least length of the word) in the order they are tried; suffixes: in that order, three letters must stay.
    stop_words: no evidence. generic and opening: stems that don't tell rows apart; formula: those of the words that rows open with."""

    marks: str = ""
    source: str = ""
    target: str = ""
    lower: bool = False
    prefixes: tuple[tuple[str, int], ...] = ()
    suffixes: tuple[str, ...] = ()
    stop_words: tuple[str, ...] = ()
    generic: tuple[str, ...] = ()
    opening: tuple[str, ...] = ()
    formula: tuple[str, ...] = ()
    #: A row opens with the phrase if it has one of the cues, the word and the stem; it nearly does with one of these or of the
    #: cues as they may be heard, nearly the stem, and the word or nearly the other stem.
    cues: tuple[str, ...] = ()
    heard_cues: tuple[str, ...] = ()
    phrase_word: str = ""
    phrase_stem: str = ""
    phrase_other: str = ""


# The Arabic profile.
ARABIC = Profile(
    marks=r"[\x{FEFF}\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06DC}\x{06DF}-\x{06E4}\x{06E7}\x{06E8}\x{06EA}-\x{06ED}\x{0640}]",
    source="آأإٱةى",
    target="ااااهي",
    prefixes=(("وال", 4), ("فال", 4), ("ال", 3), ("و", 4), ("ف", 4), ("ب", 4), ("ل", 4), ("ي", 4), ("ت", 4), ("ن", 4)),
    suffixes=("ين", "ون", "ان", "وا", "هم", "كم", "نا", "ها", "ه"),
    stop_words=tuple("هذا هذه ذلك تلك الذي الذين التي وما وهو وهي ومن وفي وال على علي الى الي في من ما لا لم لن ان".split()),
    generic=tuple("الله لله سماوات سماء ارض رب رحمن رحيم هذا هذه ذلك تلك الذي الذين التي وما وهو وهي ومن وفي وال على علي الى الي في من ما لا لم لن ان كان لقد".split()),
    opening=tuple("بسم اسم الله رحمن رحيم حمد رب عالم".split()),
    formula=tuple("بسم اسم الله رحمن رحيم".split()),
    cues=("بسم", "اسم"),
    heard_cues=("بس",),
    phrase_word="الله",
    phrase_stem="رحيم",
    phrase_other="رحمن",
)
#: For texts in Latin letters.
LATIN = Profile(
    lower=True, suffixes=("tion", "ing", "ed", "ly", "er", "es"), stop_words=("this", "that", "with", "from", "have"), generic=("this", "that", "from"), opening=("the", "and", "with"), formula=("the", "and"),
    cues=("is", "was"), heard_cues=("as",), phrase_word="the", phrase_stem="thing", phrase_other="these")

GAP = r"[\p{P}\p{S}\p{Z}\s\x{85}]+"


def collapse(text: Column) -> Column:
    """One space for each run of whitespace, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize(text: Column, profile: Profile = ARABIC) -> Column:
    """Marks dropped, punctuation and symbols to spaces, letters folded, spaces collapsed. Null stays null."""
    if profile.marks:
        text = F.regexp_replace(text, profile.marks, "")
    if profile.lower:
        text = F.lower(text)
    text = F.regexp_replace(text, GAP, " ")
    return F.trim(F.translate(text, profile.source, profile.target) if profile.source else text)


def split_words(normalized: Column) -> Column:
    """Words of a normalised text."""
    return F.filter(F.split(normalized, " "), lambda w: w != "")


def words(text: Column, profile: Profile = ARABIC) -> Column:
    return split_words(normalize(text, profile))


def stem(word: Column, profile: Profile = ARABIC) -> Column:
    """One prefix off, by the word's own length, then the first suffix that leaves three letters."""
    head = word
    for prefix, least in reversed(profile.prefixes):
        head = F.when(word.startswith(prefix) & (F.length(word) > least), F.substring(word, F.lit(len(prefix) + 1), F.length(word))).otherwise(head)

    def tail(w: Column) -> Column:
        out = w
        for suffix in reversed(profile.suffixes):
            out = F.when(w.endswith(suffix) & (F.length(w) - len(suffix) >= 3), F.substring(w, F.lit(1), F.length(w) - len(suffix))).otherwise(out)
        return out

    return F.element_at(F.transform(F.array(head), tail), 1)


def stems(words_: Column, profile: Profile = ARABIC) -> Column:
    """Stems of three letters or more, in order."""
    return F.filter(F.transform(words_, lambda w: stem(w, profile)), lambda s: F.length(s) >= 3)


def evidence_stems(words_: Column, profile: Profile = ARABIC) -> Column:
    """Distinct stems, of three letters or more, of words of four or more that aren't stop words."""
    kept = F.filter(words_, lambda w: (F.length(w) >= 4) & ~w.isin(*profile.stop_words) if profile.stop_words else F.length(w) >= 4)
    return F.array_distinct(stems(kept, profile))


def character_total(words_: Column) -> Column:
    return F.aggregate(words_, F.lit(0), lambda a, w: a + F.length(w))


def is_publishable(words_: Column) -> Column:
    """Two words and six letters, or a word of six; also what discovery asks for."""
    return ((F.size(words_) >= 2) & (character_total(words_) >= 6)) | F.exists(words_, lambda w: F.length(w) >= 6)


def is_continuation(words_: Column) -> Column:
    return (F.size(words_) >= 2) & (character_total(words_) >= 5)


def is_global_content(words_: Column) -> Column:
    return (F.size(words_) >= 3) & (character_total(words_) >= 10)


def is_generic(words_: Column, profile: Profile = ARABIC) -> Column:
    """No stem of three letters or more that isn't a generic opening."""
    return F.forall(stems(words_, profile), lambda s: s.isin(*profile.opening) if profile.opening else F.lit(False))


def _any_of(words_: Column, wanted: tuple[str, ...]) -> Column:
    return F.exists(words_, lambda w: w.isin(*wanted)) if wanted else F.lit(False)


def is_opening_phrase(words_: Column, profile: Profile = ARABIC) -> Column:
    """The profile's opening phrase, word for word."""
    has_stem = F.array_contains(F.transform(words_, lambda w: stem(w, profile)), profile.phrase_stem)
    return _any_of(words_, profile.cues) & F.array_contains(words_, profile.phrase_word) & has_stem


def is_near_opening_phrase(words_: Column, profile: Profile = ARABIC, threshold: float = 0.78) -> Column:
    """The profile's opening phrase, as it may have been heard."""
    own = F.transform(words_, lambda w: stem(w, profile))
    near = lambda wanted: F.exists(own, lambda s: 1 - F.levenshtein(s, F.lit(wanted)) / F.greatest(F.length(s), F.lit(len(wanted))) >= threshold)
    return _any_of(words_, (*profile.cues, *profile.heard_cues)) & near(profile.phrase_stem) & (near(profile.phrase_other) | F.array_contains(words_, profile.phrase_word))
