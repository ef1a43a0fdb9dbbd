"""Markup sources: line records of TEI-like XML, text of HTML pages, indented outlines, and JSON lines that may be torn."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from xml import sax

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINES = "text_id string, line_no long, linehead string, text string, notes array<struct<offset:int,text:string>>, marks array<struct<offset:int,level:int,text:string>>, caesuras array<int>, in_verse boolean, n_alt int"
EVENTS = "page_id long, seq long, event string, name string, value string"


class LineHandler(sax.ContentHandler):
    """Text between line breaks, in order across element boundaries.

    A break <lb n= ed=> of the text's own edition opens a line; one of another edition is counted as an alternative.
    Notes, marks (mulu) and headings are kept with their offset in the line; text inside notes isn't the line's. A
    character reference <g ref=> takes the character declared for it, else a placeholder.
    """

    def __init__(self, edition: str | None):
        self.edition, self.lines, self.stack, self.captured = edition, [], [], None
        self.glyphs, self.char, self.info = {}, None, {}

    def startElement(self, name: str, attrs) -> None:
        name = name.rpartition(":")[2]
        self.stack.append(name)
        if name == "lb":
            if self.edition and attrs.get("ed") and self.edition not in attrs["ed"].split():
                if self.lines:
                    self.lines[-1]["n_alt"] += 1
                return
            self.lines.append({"linehead": attrs.get("n", ""), "text": "", "notes": [], "marks": [], "caesuras": [], "in_verse": "lg" in self.stack, "n_alt": 0})
        elif name == "char":
            self.char = attrs.get("xml:id")
        elif name in ("mapping", "title", "note", "mulu"):
            self.captured = [name, attrs.get("level"), attrs.get("type"), ""]
        elif name == "caesura" and self.lines:
            self.lines[-1]["caesuras"].append(len(self.lines[-1]["text"]))
        elif name == "g":
            ref = attrs.get("ref", "").lstrip("#")
            self.emit(self.glyphs.get(ref, f"[#{ref}]"))

    def endElement(self, name: str) -> None:
        name = self.stack.pop()
        if not self.captured or self.captured[0] != name:
            return
        kind, level, type_, text = self.captured
        self.captured = None
        at = len(self.lines[-1]["text"]) if self.lines else 0
        if kind == "mapping" and self.char:
            text = chr(int(text[2:], 16)) if text.startswith("U+") else text
            if type_ == "unicode" or self.char not in self.glyphs:
                self.glyphs[self.char] = text
        elif kind == "title":
            self.info.setdefault("title", text)
        elif kind == "note" and self.lines:
            self.lines[-1]["notes"].append({"offset": at, "text": text})
        elif kind == "mulu" and self.lines:
            self.lines[-1]["marks"].append({"offset": at, "level": int(level or 1), "text": text})

    def characters(self, content: str) -> None:
        if self.captured:
            self.captured[3] += content
        else:
            self.emit(content)

    def emit(self, text: str) -> None:
        if self.lines and "teiHeader" not in self.stack:
            self.lines[-1]["text"] += text.translate({10: None, 13: None, 9: None})


def parse_lines(xml: bytes, edition: str | None = None) -> list[dict]:
    handler = LineHandler(edition)
    sax.parseString(xml, handler)
    return handler.lines


def read_lines(files: DataFrame, edition: str | None = None, id_col: str = "text_id", content_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """(lines, errors) of XML files: a row per line, and a row per file that doesn't parse."""

    item = lambda *fields: pa.list_(pa.struct(fields))
    kinds = {
        "text_id": pa.string(), "line_no": pa.int64(), "linehead": pa.string(), "text": pa.string(), "notes": item(("offset", pa.int32()), ("text", pa.string())),
        "marks": item(("offset", pa.int32()), ("level", pa.int32()), ("text", pa.string())), "caesuras": pa.list_(pa.int32()), "in_verse": pa.bool_(), "n_alt": pa.int32(), "error": pa.string(),
    }

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[dict] = []

        def made(upto: int) -> pa.RecordBatch:
            part = found[:upto]
            del found[:upto]
            return pa.RecordBatch.from_arrays([pa.array([x.get(c) for x in part], k) for c, k in kinds.items()], names=list(kinds))

        for b in batches:
            for text_id, content in zip(b.column(0), b.column(1)):
                name = text_id.as_py()
                try:
                    lines = parse_lines(content.as_py() or b"", edition)
                except sax.SAXException as e:
                    found.append({"text_id": name, "error": str(e)[:200]})
                else:
                    found.extend(x | {"text_id": name, "line_no": i} for i, x in enumerate(lines))
                while len(found) >= 2000:
                    yield made(2000)
        if found:
            yield made(2000)

    parsed = files.select(F.col(id_col).cast("string"), F.col(content_col).cast("binary")).mapInArrow(rows, LINES + ", error string")
    return parsed.where("error IS NULL").drop("error"), parsed.where("error IS NOT NULL").select("text_id", "error")


def elements_of(lines: DataFrame) -> DataFrame:
    """(text_id, line_no, kind, offset, text): every mark, note and caesura of line records, in document order."""
    at = ["text_id", "line_no"]
    marks = lines.select(*at, F.explode("marks").alias("x")).select(*at, F.lit("mulu").alias("kind"), "x.offset", "x.text")
    notes = lines.select(*at, F.explode("notes").alias("x")).select(*at, F.lit("note").alias("kind"), "x.offset", "x.text")
    cuts = lines.select(*at, F.explode("caesuras").alias("offset")).select(*at, F.lit("caesura").alias("kind"), "offset", F.lit(None).cast("string").alias("text"))
    return marks.unionByName(notes).unionByName(cuts)


class _Events(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        a = dict(attrs)
        self.found.append(("open", tag, a.get("id") or a.get("href") or a.get("class")))

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        self.found.append(("close", tag, None))

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.found.append(("text", None, re.sub(r"\s+", " ", data).strip()))


def html_events(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, seq, event, name, value): tags and text in order; script and style have no text."""
    out = pa.schema([("page_id", pa.int64()), ("seq", pa.int64()), ("event", pa.string()), ("name", pa.string()), ("value", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for page, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parser = _Events()
                parser.feed(html or "")
                parser.close()
                if parser.found:
                    n = len(parser.found)
                    yield pa.RecordBatch.from_arrays([pa.array([page] * n, pa.int64()), pa.array(range(n), pa.int64()), *(pa.array(x, pa.string()) for x in zip(*parser.found))], schema=out)

    return pages.select(F.col(id_col).cast("long"), html_col).mapInArrow(rows, EVENTS)


def read_outline(spark: SparkSession, path: str) -> DataFrame:
    """(lineno, level, label, heading, count): indented outline text, two blanks a level; a trailing count in brackets. lineno is the line's
    number in its file, from 1."""
    files = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "value"))
    return outline_rows(files.select((F.col("at") + 1).alias("lineno"), "value").where("trim(value) <> ''"))


def outline_rows(rows: DataFrame) -> DataFrame:
    form = r"^( *)([A-Z]+[0-9]+(?:-[0-9]+)?) +(.*?)(?:[(（]([0-9]+)[)）])?$"
    part = lambda k: F.regexp_extract("value", form, k)
    return rows.select("lineno", (F.floor(F.length(part(1)) / 2) + 1).cast("int").alias("level"), part(2).alias("label"), F.trim(part(3)).alias("heading"), F.nullif(part(4), F.lit("")).cast("int").alias("count"))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a line that is torn is left out."""
    return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path).where("_corrupt_record IS NULL").drop("_corrupt_record")


def latest(records: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last record of each key."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return records.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")
