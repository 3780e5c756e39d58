"""Words for lexical comparison: lower case, endings of English inflection taken off, short and stop words left out."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Words that say nothing about a text.
STOP = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
VOWELS = frozenset("aeiouy")


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """A word without plural, -ed, -ing and -ly; what is left has a vowel and three letters at least."""

    def whole(x: str) -> bool:
        return len(x) >= 3 and any(c in VOWELS for c in x)

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith("ies") and len(word) > 4:
        word = word[:-3] + "y"
    elif word.endswith("s") and not word.endswith(("ss", "us", "is")) and len(word) > 3:
        word = word[:-1]
    for end in ("ingly", "edly", "ing", "ed", "ly"):
        if word.endswith(end) and whole(word[: -len(end)]):
            word = word[: -len(end)]
            if end not in ("ly",) and len(word) > 3 and word[-1] == word[-2] and word[-1] not in "aeioulsz":
                word = word[:-1]
            elif end not in ("ly",) and word.endswith(("at", "bl", "iz")):
                word += "e"
            break
    return word


@F.pandas_udf(ArrayType(StringType()))
def stems(words: pd.Series) -> pd.Series:
    """Distinct stems of three letters or more that aren't stop words."""
    return words.map(lambda ws: sorted({s for w in (ws if ws is not None else []) if w not in STOP and len(s := stem(w)) >= 3}))


def normalized_words(texts: DataFrame) -> DataFrame:
    """(id, words) of texts (id, text)."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 0))
    return texts.select("id", stems(words).alias("words"))
