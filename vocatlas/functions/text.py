"""Analyzers: how a text becomes index tokens.

``simple``: runs of letters, digits and underscores, lower-cased; all of it in
built-in functions. ``english``: runs also join over ``.``, ``:`` and ``'``
between letters and over ``.``, ``,``, ``;`` and ``'`` between digits (word
breaks as in UAX 29), a possessive ``'s`` goes, stop words go, and the rest is
stemmed by Porter's algorithm of 1980, in an Arrow function that stems each
distinct token of a batch once.

Null texts have no tokens.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANALYZERS = ("simple", "english")
SIMPLE = r"[\p{L}\p{N}_]+"
JOINED = r"[\p{L}\p{N}_]+(?:(?:(?<=\p{L})[.:'’](?=\p{L})|(?<=\p{N})[.,;'’](?=\p{N}))[\p{L}\p{N}_]+)*"

# The customary short English stop list.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not",
    "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)


def _kinds(w: str) -> list[bool]:
    """By letter, whether it counts as a consonant; y does after a vowel or at the start."""
    out: list[bool] = []
    for c in w:
        out.append((not out or not out[-1]) if c == "y" else c not in "aeiou")
    return out


def _measure(stem: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    kinds = _kinds(stem)
    return sum(1 for a, b in zip(kinds, kinds[1:]) if not a and b)


def _has_vowel(stem: str) -> bool:
    return not all(_kinds(stem))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _kinds(w)[-1]


def _cvc(w: str) -> bool:
    return _kinds(w)[-3:] == [True, False, True] and w[-1] not in "wxy"


# The algorithm's suffix tables.
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(w: str, pairs: tuple) -> tuple[str, str] | None:
    fit = [p for p in pairs if w.endswith(p[0])]
    return max(fit, key=lambda p: len(p[0])) if fit else None


@lru_cache(maxsize=1 << 17)
def porter(w: str) -> str:
    """The Porter stem of a lower-case word."""
    return _stem(w) if len(w) > 2 else w


def _stem(w: str) -> str:
    # 1a
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # 1b
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((s for s in ("ed", "ing") if w.endswith(s) and _has_vowel(w[: -len(s)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    # 1c
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    # 2, 3
    for pairs in (_STEP2, _STEP3):
        if (hit := _longest(w, pairs)) and _measure(w[: -len(hit[0])]) > 0:
            w = w[: -len(hit[0])] + hit[1]
    # 4
    if hit := _longest(w, tuple((s, "") for s in _STEP4)):
        stem = w[: -len(hit[0])]
        if _measure(stem) > 1 and (hit[0] != "ion" or stem.endswith(("s", "t"))):
            w = stem
    # 5
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stemmed(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda ts: None if ts is None else [porter(t) for t in ts])


def tokens(text: Column, analyzer: str = "simple") -> Column:
    """The tokens of a text, in order, with repeats."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    if analyzer == "simple":
        return F.regexp_extract_all(lower, F.lit(SIMPLE), F.lit(0))
    if analyzer != "english":
        raise ValueError(f"unknown analyzer {analyzer!r}; known: {ANALYZERS}")
    found = F.transform(F.regexp_extract_all(lower, F.lit(JOINED), F.lit(0)), lambda t: F.regexp_replace(t, r"['’]s$", ""))
    return _stemmed(F.filter(found, lambda t: ~t.isin(*STOP_WORDS) & (t != "")))
