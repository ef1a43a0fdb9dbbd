"""Announced divisions of a text: statements found by rules, judged by an additive score, and built into a tree.

The rules are a table, so that one scanner serves any script. A rule has a kind (announce, enter, close), a pattern
with the groups it needs (count, labels, ordinal, subject) and a place in the order: at one position the first rule of
the table that matches wins, then the longest match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import similarity

#: The numerals' digits, the words that announce, divide, open and end a part.
DIGITS = "一二三四五六七八九"
UNITS = "段門科義種節意分章"
STATEMENTS = "doc_id long, seq long, kind string, rule string, char_start long, char_end_excl long, count long, ordinal long, subject string, labels array<string>"
NODES = "doc_id long, node long, parent long, level long, sibling long, heading string, char_start long, announced long, flag string"


class Rule(NamedTuple):
    """`anchor` matches in every match of the pattern, at most `back` characters after its start: only starts near one are tried."""

    name: str
    kind: str
    pattern: str
    anchor: str | None = None
    back: int = 0


NUMBER = f"[{DIGITS}十]+"
CJK = [
    Rule("verb-count", "announce", rf"(?P<subject>[^。，；：]{{0,12}})(?:分為|分作|開為|略有|大分|文分|有)(?P<count>{NUMBER})(?P<unit>[{UNITS}])?[。：，]?(?P<labels>(?:(?:{NUMBER}[^。、，；]{{1,20}}[、，；])*{NUMBER}[^。、，；]{{1,20}}。)?)", rf"(?:分為|分作|開為|略有|大分|文分|有)[{DIGITS}十]", 12),
    Rule("ordinal", "enter", rf"(?:^|(?<=[。\n]))第?(?P<ordinal>{NUMBER})(?P<subject>[^。，；：]{{1,12}})(?:者|中)[，。：]", f"[第{DIGITS}十]"),
    Rule("first", "enter", r"(?:^|(?<=[。\n]))(?P<ordinal>初)(?P<subject>[^。，；：]{1,12})(?:者|中)[，。：]", "初"),
    Rule("done", "close", r"(?P<subject>[^。，；：]{0,12})(?:竟|已竟|訖)。", "[竟訖]。", 13),
]
LATIN = [
    Rule("count-of", "announce", r"(?P<subject>[A-Za-z ]{0,40}?)\b(?:has|have|into|in) (?P<count>two|three|four|five|six|[2-9]) (?P<unit>parts|sections|kinds|points)[:.]?(?P<labels>(?: ?(?:first|second|third|fourth|fifth|sixth|\([0-9]\)),? [^;.]{1,60}[;.])*)", r"\b(?:has|have|into|in) [2-9tfs]", 40),
    Rule("ordinal", "enter", r"(?:^|(?<=[.\n] )|(?<=\n))(?P<ordinal>First|Second|Third|Fourth|Fifth|Sixth),? (?P<subject>[^,.:;]{1,60})[,.:]"),
    Rule("done", "close", r"(?:This|So) (?:ends|much for) (?P<subject>[^.]{1,60})\."),
]
WORDS = {w: i for group in ("one two three four five six", "first second third fourth fifth sixth") for i, w in enumerate(group.split(), 1)}


def number(text: str | None) -> int | None:
    """The number that digits, an English word, 初 or a numeral up to 99 writes."""
    if not text:
        return None
    if text.isdigit():
        return int(text)
    if text.lower() in WORDS:
        return WORDS[text.lower()]
    if text == "初":
        return 1
    tens, ten, units = text.rpartition("十") if "十" in text else ("", "", text)
    if len(tens) > 1 or len(units) > 1 or any(c not in DIGITS for c in tens + units):
        return None
    return (DIGITS.index(tens) + 1 if tens else 1 if ten else 0) * 10 * bool(ten) + (DIGITS.index(units) + 1 if units else 0) or None


def labels_of(text: str | None) -> list[str]:
    """Labels of an ordinal listing that counts up from one; what breaks the count ends the listing."""
    parts = re.split(rf"(?:^|(?<=[、，；;。.\s]))(?:({NUMBER}|\([0-9]\)|first|second|third|fourth|fifth|sixth),?)", text or "")
    found = []
    for mark, label in zip(parts[1::2], parts[2::2]):
        if number(mark.strip("()")) != len(found) + 1:
            break
        found.append(label.strip("、，；;。. "))
    return found


def matches(rule: Rule, text: str) -> Iterator[re.Match]:
    """re.finditer() of the rule's pattern. With an anchor each start is tried once, and only where one follows near enough."""
    if rule.anchor is None:
        yield from re.finditer(rule.pattern, text)
        return
    pattern, anchor = re.compile(rule.pattern), re.compile(rule.anchor)
    untried, hit = 0, anchor.search(text)
    while hit:
        found = next((m for at in range(max(untried, hit.start() - rule.back), hit.start() + 1) if (m := pattern.match(text, at))), None)
        untried = found.end() if found else hit.start() + 1
        if found:
            yield found
        hit = anchor.search(text, untried)


def scan(text: str, rules: list[Rule]) -> list[dict]:
    """Statements in order; matches that begin inside an earlier one are left out."""
    hits = sorted((m.start(), k, -m.end(), m) for k, r in enumerate(rules) for m in matches(r, text) if m.end() > m.start())
    found, after = [], 0
    for start, k, end, m in hits:
        if start < after:
            continue
        g = m.groupdict()
        found.append({"kind": rules[k].kind, "rule": rules[k].name, "char_start": start, "char_end_excl": -end, "count": number(g.get("count")), "ordinal": number(g.get("ordinal")), "subject": (g.get("subject") or "").strip(), "labels": labels_of(g.get("labels"))})
        after = -end
    return found


def judged(statement: dict, later: list[dict]) -> tuple[int, list[str]]:
    """Points for an announcement being a division rather than a list, and the reasons that gave them."""
    labels, n = statement["labels"], statement["count"]
    entered = [s for s in later if s["kind"] == "enter"]
    terms = [
        (2, "all labels listed", n is not None and len(labels) == n),
        (-1, "labels missing", bool(labels) and len(labels) != n),
        (2, "a label is taken up", any(similarity(s["subject"], x) >= 0.6 for s in entered for x in labels)),
        (1, "ordinals follow", any(s["ordinal"] == 1 for s in entered)),
        (-2, "nothing follows", not entered),
    ]
    return sum(p for p, _, true in terms if true), [why for _, why, true in terms if true]


def build(statements: list[dict], margin: int = 1) -> list[dict]:
    """Nodes from statements: a cursor walks the tree that announcements open and entries move through.

    An accepted announcement divides the node at the cursor (or the child whose label its subject names) into its
    labels, unnamed where not listed. An entry goes to the child that its ordinal or subject names, of the nearest
    division around the cursor that has one; an entry that names none is reported as lost. A close moves up.
    """
    nodes = [{"node": 0, "parent": None, "level": 0, "sibling": 1, "heading": "", "char_start": 0, "announced": None, "flag": None}]
    kids: dict[int, list[int]] = {}
    cursor = 0

    def up(i: int) -> Iterator[int]:
        while i is not None:
            yield i
            i = nodes[i]["parent"]

    def named(parent: int, subject: str, ordinal: int | None) -> int | None:
        own = kids.get(parent, [])
        if ordinal and ordinal <= len(own):
            child = own[ordinal - 1]
            if not subject or not nodes[child]["heading"] or similarity(subject, nodes[child]["heading"]) > 0 or nodes[child]["char_start"] is None:
                return child
        best = max(own, key=lambda c: similarity(subject, nodes[c]["heading"]), default=None)
        return best if best is not None and similarity(subject, nodes[best]["heading"]) >= 0.6 else None

    for at, s in enumerate(statements):
        if s["kind"] == "announce" and s["count"]:
            if judged(s, statements[at + 1 :])[0] < margin:
                continue
            target = next((c for p in up(cursor) if s["subject"] and (c := named(p, s["subject"], None)) is not None), cursor)
            if target in kids:
                continue
            kids[target] = []
            nodes[target]["announced"] = s["count"]
            nodes[target]["flag"] = "count_mismatch" if s["labels"] and len(s["labels"]) != s["count"] else None
            for k in range(s["count"]):
                kids[target].append(len(nodes))
                nodes.append({"node": len(nodes), "parent": target, "level": nodes[target]["level"] + 1, "sibling": k + 1, "heading": s["labels"][k] if k < len(s["labels"]) else "", "char_start": None, "announced": None, "flag": None})
            cursor = target
        elif s["kind"] == "enter":
            child = next((c for p in up(cursor) if (c := named(p, s["subject"], s["ordinal"])) is not None), None)
            if child is not None:
                nodes[child]["char_start"] = s["char_start"] if nodes[child]["char_start"] is None else nodes[child]["char_start"]
                nodes[child]["heading"] = nodes[child]["heading"] or s["subject"]
                cursor = child
        elif s["kind"] == "close" and nodes[cursor]["parent"] is not None:
            cursor = nodes[cursor]["parent"]
    return nodes[1:]


def statements_of(documents: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, seq, kind, rule, char_start, char_end_excl, count, ordinal, subject, labels), offsets in code points."""

    return scanned(documents, lambda t: ({"seq": k, **s} for k, s in enumerate(scan(t, rules))), STATEMENTS, id_col, text_col)


def outlines_of(documents: DataFrame, rules: list[Rule], margin: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """NODES of each document's outline; a document is read whole in one row, so nothing is shuffled."""
    return scanned(documents, lambda t: build(scan(t, rules), margin), NODES, id_col, text_col)


def scanned(documents: DataFrame, made, schema: str, id_col: str, text_col: str) -> DataFrame:
    """A row of the schema per item of made(text), with the document's id; columns are made whole, in Arrow."""
    kinds = {"long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    out = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found = [(i, x) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for x in made(t or "")]
                columns = [pa.array([i for i, _ in found], pa.int64()), *(pa.array([x.get(f.name) for _, x in found], f.type) for f in list(out)[1:])]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return documents.select(F.col(id_col).cast("long"), text_col).mapInArrow(rows, schema)
