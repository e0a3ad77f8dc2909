"""The Porter stemmer, over Arrow batches of words."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .workers import ship

STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _by_last(rules: list[tuple[str, str]]) -> dict[str, list[tuple[str, str]]]:
    """Endings by their last letter, longest first."""
    out: dict[str, list[tuple[str, str]]] = {}
    for rule in sorted(rules, key=lambda x: -len(x[0])):
        out.setdefault(rule[0][-1], []).append(rule)
    return out


BY_LAST_2, BY_LAST_3, BY_LAST_4 = _by_last(STEP_2), _by_last(STEP_3), _by_last([(end, "") for end in STEP_4])


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not _vowel(w, i - 1))


def _measure(w: str) -> int:
    """Times that a vowel is followed by a consonant."""
    times, last = 0, False
    for i, x in enumerate(w):
        now = x in "aeiou" or (x == "y" and i > 0 and not last)
        times += last and not now
        last = now
    return times


def _short(w: str) -> bool:
    n = len(w)
    return n >= 3 and not _vowel(w, n - 3) and _vowel(w, n - 2) and not _vowel(w, n - 1) and w[-1] not in "wxy"


def _double(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and not _vowel(w, len(w) - 1)


@lru_cache(100_000)
def porter(w: str) -> str:
    """The stem of a lower-case word (M. F. Porter, 1980, with the author's later changes to step 2)."""
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    has_vowel = lambda x: any(_vowel(x, i) for i in range(len(x)))
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (BY_LAST_2, BY_LAST_3):
        for end, new in table.get(w[-1:], ()):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end, _ in BY_LAST_4.get(w[-1:], ()):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stem(words: str | Column) -> Column:
    """The stems of a column of lower-case words."""

    ship(SparkSession.active())

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda w: w if w is None else porter(w))

    return run(words)
