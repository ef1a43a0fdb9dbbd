"""Approximate string search, as Arrow-batched functions: no built-in expression gives these."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as t

PLACE = t.StructType([t.StructField("method", t.StringType()), t.StructField("start", t.IntegerType()), t.StructField("end_excl", t.IntegerType())])
LENGTHS = t.StructType([t.StructField("substring", t.IntegerType()), t.StructField("subsequence", t.IntegerType())])


def common_substring(a: str, b: str) -> int:
    """Length of the longest common substring."""
    best, row = 0, [0] * (len(b) + 1)
    for ch in a:
        last = 0
        for j, other in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if ch == other else 0
            best = max(best, row[j])
    return best


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits: a set bit marks where the row's value rises."""
    at: dict[str, int] = {}
    for j, ch in enumerate(b):
        at[ch] = at.get(ch, 0) | 1 << j
    rises = 0
    for ch in a:
        x = rises | at.get(ch, 0)
        rises = x & ~(x - (rises << 1 | 1))
    return rises.bit_count()


#: How many characters may stand between two that follow one another, and the character that stands for any.
MOST_BETWEEN, ANY = 6, "等"


@lru_cache(4096)
def loose(needle: str) -> re.Pattern | None:
    """The needle's characters with at most MOST_BETWEEN others before each but the first two, which stand together; ANY is
    left out. None for fewer than three characters.

    What stands between can't be the character that is waited for, so each is met at its first place and nothing is tried
    twice.
    """
    chars = [re.escape(c) for c in needle if c != ANY]
    if len(chars) < 3:
        return None
    return re.compile(chars[0] + chars[1] + "".join(rf"[^{c}]{{0,{MOST_BETWEEN}}}{c}" for c in chars[2:]), re.DOTALL)


def bare(text: str) -> tuple[str, list[int]]:
    """The text without punctuation, white space and controls, and where each character left stood."""
    kept = [(c, i) for i, c in enumerate(text) if unicodedata.category(c)[0] not in "PZ" and unicodedata.category(c) not in ("Cc", "Cf")]
    return "".join(c for c, _ in kept), [i for _, i in kept]


def longest_part(text: str, needle: str, least: int, part) -> tuple[int, int] | None:
    """Place of the longest part(k) of the needle, least <= k < its length, in the text: where one is found, so are all
    shorter ones, so the length is bisected."""
    low, high = least - 1, len(needle) - 1
    while low < high:
        k = (low + high + 1) // 2
        low, high = (k, high) if part(k) in text else (low, k - 1)
    if low < least:
        return None
    at = text.find(part(low))
    return at, at + low


def staged(text: str | None, needle: str | None, least: int = 4) -> tuple[str, int, int] | None:
    """(method, start, end) of the needle, punctuation on both sides left out: whole, else with gaps, else its longest suffix
    of `least` characters at least, else such a prefix. Offsets are the whole text's."""
    hay, keep = bare(text or "")
    part, _ = bare(needle or "")
    if not part:
        return None
    pattern = loose(part)
    tries = {
        "whole": lambda: re.search(re.escape(part), hay),
        "gapped": lambda: pattern and pattern.search(hay),
        "suffix": lambda: longest_part(hay, part, least, lambda k: part[-k:]),
        "prefix": lambda: longest_part(hay, part, least, lambda k: part[:k]),
    }
    for method, attempt in tries.items():
        if found := attempt():
            start, end = found if isinstance(found, tuple) else found.span()
            return method, keep[start], keep[end - 1] + 1
    return None


@F.pandas_udf(PLACE)
def find_staged(text: pd.Series, needle: pd.Series) -> pd.DataFrame:
    found = [staged(x, n) or (None, None, None) for x, n in zip(text, needle)]
    return pd.DataFrame(found, columns=["method", "start", "end_excl"]).astype({"start": "Int32", "end_excl": "Int32"})


@F.pandas_udf(LENGTHS)
def common_lengths(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    pairs = [(x or "", y or "") for x, y in zip(a, b)]
    return pd.DataFrame({"substring": [common_substring(x, y) for x, y in pairs], "subsequence": [common_subsequence(x, y) for x, y in pairs]}).astype("int32")
