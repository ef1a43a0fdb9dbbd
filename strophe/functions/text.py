"""Scalar text functions as column expressions: normalisation, labels, numerals, locators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode categories that count as punctuation: all P*, all Z*, controls and format characters.
PUNCT = r"[\p{P}\p{Z}\p{Cc}\p{Cf}]"
#: The ten digits of the numerals.
DIGITS = "一二三四五六七八九"


def strip_punct(text: Column) -> Column:
    return F.regexp_replace(text, PUNCT, "")


def kept_positions(text: Column) -> Column:
    """0-based code-point offsets of the characters that strip_punct keeps: maps stripped offsets back."""
    marked = F.transform(characters(text), lambda c, i: F.when(~c.rlike(PUNCT), i))
    return F.filter(marked, lambda i: i.isNotNull())


def first_bare_hit(text: Column, needle: str) -> Column:
    """(start, end_excl), in code points of the text, of the first place where strip_punct(text) holds the needle; null without one.

    One search of the text itself, so nothing is made for each of its characters as by kept_positions().
    """
    form = f"{PUNCT}*".join(rf"\x{{{ord(c):x}}}" for c in needle)
    before = F.length(F.element_at(F.split(text, form, 2), 1))
    place = F.struct(before.alias("start"), (before + F.length(F.regexp_extract(text, form, 0))).alias("end_excl"))
    bare = F.length(strip_punct(F.lit(needle))) == len(needle)  # a needle that strip_punct cuts is nowhere
    return F.when((F.lit(len(needle)) > 0) & bare & text.rlike(form), place)


def hits(text: Column, needle: Column) -> Column:
    """0-based offsets of all occurrences, overlapping ones too; none of an empty needle."""
    from ..operators.segment import starts_of

    pieces = F.split(text, F.concat(F.lit("(?=\\Q"), needle, F.lit("\\E)")))  # each begins where the needle does, but perhaps the first
    starts = starts_of(F.transform(pieces, lambda x: F.length(x).cast("bigint")))
    found = F.filter(F.transform(starts, lambda s, i: F.when((i > 0) | F.startswith(text, needle), s.cast("int"))), lambda s: s.isNotNull())
    return F.when(F.length(needle) > 0, found).otherwise(F.array().cast("array<int>"))


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def label_similarity(x: Column, label: Column) -> Column:
    """0 if either is empty, 1 if equal; a label of one character: 0.9 at either end of x, else 0; if one contains the
    other, 0.9 where the shorter is at least half as long and 0.6 where not; else the share of the label's distinct
    characters that x has."""
    short, long = F.least(F.length(x), F.length(label)), F.greatest(F.length(x), F.length(label))
    kinds = F.array_distinct(characters(label))
    share = F.try_divide(F.size(F.array_intersect(characters(x), kinds)), F.size(kinds))
    return (
        F.when(short == 0, 0.0)
        .when(x == label, 1.0)
        .when(F.length(label) == 1, F.when(F.startswith(x, label) | F.endswith(x, label), 0.9).otherwise(0.0))
        .when(F.contains(x, label) | F.contains(label, x), F.when(short * 2 >= long, 0.9).otherwise(0.6))
        .otherwise(share)
    )


def similarity(x: str, label: str) -> float:
    """label_similarity() of two strings."""
    if "" in (x, label):
        return 0.0
    ends, holds = {x[0], x[-1]}, x in label or label in x
    halved = max(len(x), len(label)) <= 2 * min(len(x), len(label))
    rules = [(x == label, 1.0), (len(label) == 1, 0.9 if label in ends else 0.0), (holds, 0.9 if halved else 0.6)]
    return next((score for true, score in rules if true), len(set(label).intersection(x)) / len(set(label)))


def subsequence(x: Column, label: Column) -> Column:
    """The label holds the characters of x, which isn't empty, in order."""
    return (F.length(x) > 0) & (F.aggregate(characters(label), F.length(x) * 0, lambda k, c: F.when(c == F.substring(x, k + 1, F.lit(1)), k + 1).otherwise(k)) == F.length(x))


def title_name(heading: Column) -> Column:
    """A heading's bare name: no brackets, leading number, trailing ordinal or white space at the ends; lower case."""
    bare = F.regexp_replace(heading, r"\([^)]*\)|\[[^\]]*\]", "")
    bare = F.regexp_replace(bare, r"^[ \t]*[0-9]+([.-][0-9]+)*[.):]?[ \t]+", "")
    bare = F.regexp_replace(bare, r"[ \t#]+[0-9]+[ \t]*$", "")
    return F.lower(F.trim(bare))


def trailing_count(heading: Column) -> Column:
    """A count announced at a heading's end, in brackets or bare; null without one."""
    return F.nullif(F.regexp_extract(heading, r"[(\[ ]([0-9]+)[)\]]?$", 1), F.lit("")).try_cast("bigint")


def numeral(n: Column) -> Column:
    """The numeral of 1..199: units, tens without a leading one, hundreds as 百 with 零 before bare units."""
    digit = lambda k: F.substring(F.lit(DIGITS), k, F.lit(1))
    n = n.cast("int")
    rest = n % 100
    tens, units = F.floor(rest / 10).cast("int"), rest % 10
    below = F.concat(
        F.when(tens == 0, "").when((tens == 1) & (n < 100), "十").otherwise(F.concat(digit(tens), F.lit("十"))),
        F.when(units == 0, "").otherwise(digit(units)),
    )
    hundred = F.concat(F.lit("一百"), F.when((tens == 0) & (units > 0), "零").otherwise(""), below)
    return F.when((n < 1) | (n > 199), None).when(n < 100, below).otherwise(hundred)


def numeral_value(text: Column) -> Column:
    """The number that a numeral() writes, 一十 and a missing 零 or leading 一 allowed; null for anything else."""
    whole = r"^(一?百)?零?(([二三四五六七八九一])?(十))?([一二三四五六七八九])?$"
    part = lambda k: F.regexp_extract(text, whole, k)
    tens = F.when(part(4) == "", 0).when(part(3) == "", 1).otherwise(F.instr(F.lit(DIGITS), part(3)))
    units = F.when(part(5) == "", 0).otherwise(F.instr(F.lit(DIGITS), part(5)))
    value = F.when(part(1) == "", 0).otherwise(100) + tens * 10 + units
    return F.when(text.rlike(whole) & (value > 0), value)


def locator(ref: Column) -> Column:
    """A line reference FILE_pPPPPrLL[:offset] as a struct file, page, register, line, offset; null if it is none."""
    form = r"^([A-Z]+[0-9]+n[0-9A-Za-z]+)_p([0-9]+)([a-z])([0-9]{2})(?::([0-9]+))?$"
    part = lambda k: F.regexp_extract(ref, form, k)
    number = lambda k: F.nullif(part(k), F.lit("")).cast("int")
    return F.when(ref.rlike(form), F.struct(part(1).alias("file"), number(2).alias("page"), part(3).alias("register"), number(4).alias("line"), number(5).alias("offset")))
