"""Column expressions on outline nodes and their locators: which line a node is read at, what kind it is, how it is shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import numeral, numeral_value

#: The labels of levels 1 to 22, digits written below the line, and characters of private use.
LEVELS = "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥"
LOW_DIGITS = "₀₁₂₃₄₅₆₇₈₉"
PRIVATE = r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]"
OUT_OF_SPAN = "out of span"


def key_line(start: Column, has_start: Column, explained: Column, gold: Column) -> Column:
    """The line that a node is scored on by its span start; a gold node that lacks the field is read where it is explained."""
    return F.when(gold & ~has_start, explained).otherwise(start)


def marker_locator(announced: Column, explained: Column, root_start: Column) -> Column:
    """Where a node's marker stands: announced, else explained, else the root text's start; empty ones don't count."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in (announced, explained, root_start)))


def listed_only(announced: Column, explained: Column) -> Column:
    """A node that is listed and never taken up: explained where it is announced, at a character offset."""
    return F.coalesce((announced == explained) & F.contains(announced, F.lit(":")), F.lit(False))


def node_kind(announced: Column, explained: Column, node_class: Column) -> Column:
    return F.when(listed_only(announced, explained), "listed_only").when(node_class == "commentary-internal", "commentary_internal").otherwise("taken_up")


def out_of_span(notes: Column) -> Column:
    """One of the notes says so."""
    return F.coalesce(F.exists(notes, lambda n: F.startswith(n, F.lit(OUT_OF_SPAN))), F.lit(False))


def depth_band(level: Column) -> Column:
    return F.when(level <= 3, "1-3").when(level <= 6, "4-6").when(level <= 9, "7-9").when(level <= 12, "10-12").otherwise("13+")


def has_private(text: Column) -> Column:
    return text.rlike(PRIVATE)


def level_label(level: Column, sibling: Column) -> Column:
    """The level's character and the sibling's numeral; null beyond 22 levels or 99 siblings."""
    return F.when((level <= len(LEVELS)) & (sibling <= 99), F.concat(F.substring(F.lit(LEVELS), level.cast("int"), F.lit(1)), numeral(sibling)))


def indicator(path: Column) -> Column:
    """A path of tokens value_level as values, each followed by its level in low digits."""
    return F.array_join(F.transform(path, lambda x: F.concat(F.regexp_extract(x, "^(.*)_([^_]*)$", 1), F.translate(F.regexp_extract(x, "^(.*)_([^_]*)$", 2), "0123456789", LOW_DIGITS))), "")


def strip_ordinal(heading: Column) -> Column:
    """A heading without its leading ordinal such as 2 or 2-3."""
    return F.trim(F.regexp_replace(heading, r"^[0-9]+(-[0-9]+)?\s", ""))


def short_work(file: Column) -> Column:
    """A work's id from a file's: the canon's letters and the number after n, without the volume."""
    return F.regexp_replace(file, "^([A-Z]+)[0-9]+n(.+)$", "$1$2")


def letter_depth(letters: Column) -> Column:
    """A to Z are 1 to 26, a to z 27 to 52; null for anything else."""
    code = F.ascii(letters)
    return F.when(letters.rlike("^[A-Z]$"), code - 64).when(letters.rlike("^[a-z]$"), code - 70)


def count_value(token: Column) -> Column:
    """The number that digits or a numeral of at most three characters write; null if it is none."""
    return F.when(token.rlike("^[0-9]+$"), token.try_cast("bigint")).when((F.length(token) <= 3) & ~token.rlike("[百零]"), numeral_value(token).cast("bigint"))


def span_ends(spec: Column) -> Column:
    """A..B as a struct of first and last; null for anything else."""
    part = lambda k: F.regexp_extract(spec, r"^(.+?)\.\.(.+)$", k)
    return F.when(spec.rlike(r"^.+?\.\..+$"), F.struct(F.trim(part(1)).alias("first"), F.trim(part(2)).alias("last")))


def lemma_parts(raw: Column, until: str = "至") -> Column:
    """(a, b) of every place where the text is divided by `until` with something on both sides, left to right; the whole as
    (a, null) if there is none."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(raw), F.lit(1))), lambda i: F.substring(raw, i, F.lit(1)) == until)
    both = F.transform(at, lambda i: F.struct(F.substring(raw, F.lit(1), i - 1).alias("a"), F.substring(raw, i + 1, F.length(raw)).alias("b")))
    both = F.filter(both, lambda x: (F.trim(x["a"]) != "") & (F.trim(x["b"]) != ""))
    return F.when(F.size(both) > 0, both).when(F.trim(raw) != "", F.array(F.struct(raw.alias("a"), F.lit(None).cast("string").alias("b"))))


def marker_line(shown: Column, heading: Column, locator: Column) -> Column:
    return F.concat(F.lit("["), shown, F.lit(") "), heading, F.when(F.coalesce(locator, F.lit("")) != "", F.concat(F.lit(" "), locator)).otherwise(""), F.lit("]"))


def parse_marker(line: Column, locator: str = r"[A-Z]+[0-9]+n[0-9A-Za-z]+_p[0-9]+[a-z][0-9]{2}(?::[0-9]+)?") -> Column:
    """marker_line() as a struct of indicator, heading and locator; null for any other line."""
    form = rf"^\[([^)]*)\) (.*?)(?: ({locator}))?\]$"
    part = lambda k: F.regexp_extract(line, form, k)
    return F.when(line.rlike(form), F.struct(part(1).alias("indicator"), part(2).alias("heading"), F.nullif(part(3), F.lit("")).alias("locator")))


def quote_kind(before: Column, after: Column, length: Column) -> Column:
    """The kind of a quotation by the four characters before it, the three after it, and its length with the marks."""
    ends = lambda *words: before.rlike("(" + "|".join(words) + ")$")
    return (
        F.when(ends("經[：:]?") | after.rlike("^(下|以下|已下|去|至|訖|等)") | ends("從", "至", "訖"), "lemma")
        .when(ends("答曰?[：:]"), "dialog")
        .when(ends("問曰?[：:]"), "question")
        .when((length <= 14) & ~ends("云：?", "曰：", "言：?", "說"), "term")
        .otherwise("citation")
    )


#: Words that open a subject without being part of it, and particles that end it.
OPENING = "今初|此初|今|然|又|且|即|則|其|此之|此|所言|言|就|於|釋|列|辨|明|次|是"
ENDING = "之中|中|者|段|下"


def bare_subject(text: Column) -> Column:
    """A subject without quotation marks, marks and blanks at its ends, one opening word and one final particle."""
    open_ = F.regexp_replace(text, "[「『〈《]", "")
    trimmed = F.regexp_replace(open_, "^[：:，, ]+|[：:，, ]+$", "")
    return F.regexp_replace(F.regexp_replace(trimmed, f"^(?:{OPENING})", ""), f"(?:{ENDING})$", "")


def bare_heading(heading: Column, expected: Column) -> Column:
    """A heading without leading ordinal, 【】 around it and remarks in brackets at its end; a trailing numeral goes only if
    it is one of the expected counts, being the heading's own otherwise."""
    plain = strip_ordinal(heading)
    wrapped = F.regexp_replace(plain, r"^【([^】]*\S[^】]*)】", "$1")
    bare = F.regexp_replace(wrapped, r"^(.*?\S)(?:\s*[(（][^()（）]*[)）])+$", "$1")
    tail = F.regexp_extract(bare, r"^.*?\S([0-9]+|[一二三四五六七八九十]{1,3})$", 1)
    cut = F.trim(F.substring(bare, F.lit(1), F.length(bare) - F.length(tail)))
    return F.when((tail != "") & F.array_contains(expected.cast("array<bigint>"), count_value(tail)), cut).otherwise(bare)
