"""Porter stemming (the 1980 rules, with ``abli`` and without ``logi``).

``stem`` works on one word; ``stem_arrays`` is the Arrow UDF for columns.  A
word's shape is kept as a string of ``c`` and ``v``, so every condition of the
algorithm is a question about that string, and long runs need no recursion.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STEP_2 = dict(
    ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize",
    ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble",
)
_STEP_3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _form(word: str) -> str:
    """Which letters are vowels; y is one after a consonant."""
    out = []
    for k, letter in enumerate(word):
        out.append("v" if letter in "aeiou" or letter == "y" and k and out[-1] == "c" else "c")
    return "".join(out)


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _form(word)))


def _vowel(word: str) -> bool:
    return "v" in _form(word)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _form(word)[-1] == "c"


def _short_end(word: str) -> bool:
    return len(word) > 2 and _form(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _mapped(word: str, rules: dict[str, str]) -> str:
    for end, new in rules.items():
        if word.endswith(end):
            head = word[: -len(end)]
            return head + new if _measure(head) > 0 else word
    return word


def _plural(word: str) -> str:
    if word.endswith(("sses", "ies")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    cut = 2 if word.endswith("ed") else 3 if word.endswith("ing") else 0
    if not cut or not _vowel(word[:-cut]):
        return word
    word = word[:-cut]
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if _double(word) and word[-1] not in "lsz":
        return word[:-1]
    return word + "e" if _measure(word) == 1 and _short_end(word) else word


def _ending(word: str) -> str:
    for end in _STEP_4:
        if word.endswith(end):
            head = word[: -len(end)]
            fits = end != "ion" or head[-1:] in ("s", "t")
            return head if fits and _measure(head) > 1 else word
    return word


def _final(word: str) -> str:
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _short_end(word[:-1]):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    word = _past(_plural(word.lower()))
    if word.endswith("y") and _vowel(word[:-1]):
        word = word[:-1] + "i"
    return _final(_ending(_mapped(_mapped(word, _STEP_2), _STEP_3)))


class PorterStemmer:
    def stem_word(self, word: str) -> str:
        return stem(word)

    def stem_all(self, words: list[str]) -> list[str]:
        return [stem(w) for w in words]


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_arrays(words: pd.Series) -> pd.Series:
    return words.map(lambda a: None if a is None else [stem(w) for w in a])
