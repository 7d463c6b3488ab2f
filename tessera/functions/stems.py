"""English word stems by the algorithm of Porter (1980)."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Suffixes of the published algorithm and what takes their place, step by step.
STEP_2 = dict(zip("ational tional enci anci izer abli alli entli eli ousli ization ation ator alism iveness fulness ousness aliti iviti biliti".split(), "ate tion ence ance ize able al ent e ous ize ate ate al ive ful ous al ive ble".split()))
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """c and v for consonants and vowels; y is a vowel after a consonant."""
    out = ""
    for i, letter in enumerate(word):
        out += "v" if letter in "aeiou" or (letter == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often a run of vowels is followed by a run of consonants."""
    return len(re.findall("v+c", _shape(stem)))


def _short_end(stem: str) -> bool:
    """Ends in consonant, vowel, consonant other than w, x and y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of other letters than a to z and of fewer than three stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith("s"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word if word.endswith("ss") else word[:-1]
    ending = _longest(word, ("eed", "ed", "ing"))
    if ending == "eed":
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif ending and "v" in _shape(word[: -len(ending)]):
        word = word[: -len(ending)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short_end(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP_2, STEP_3):
        ending = _longest(word, table)
        if ending and _measure(word[: -len(ending)]) > 0:
            word = word[: -len(ending)] + table[ending]
    ending = _longest(word, STEP_4)
    if ending:
        rest = word[: -len(ending)]
        if _measure(rest) > 1 and (ending != "ion" or rest.endswith(("s", "t"))):
            word = rest
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short_end(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(T.StringType())
def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda w: stem(w) if isinstance(w, str) else None)


def stemmed(c: Column | str) -> Column:
    return _stems(c)
