"""Queries on texts made of table values: announced divisions, quotations, outlines as text, markdown of chunks, answers and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import nodes as N
from ..functions import quotes
from ..operators import formula, intervals, sequences, tree
from ..sources import markup
from .outlines import CHAINED_SQL, chained
from .records import first_of
from .relations import NODES_SQL, SPANS_SQL, event_spans, nodes_of
from .tables import load, spread
from .texts import LINES_SQL, lines_of

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# ---- announced divisions ---------------------------------------------------------------------------------------------

#: Parts as texts that announce three, or in every fourth part two, divisions, list them and take them up one after another.
DIVIDED_SQL = """dv AS (SELECT p_partkey AS doc_id, p_partkey % 4 = 0 AS two, substring('天地玄黃宇宙洪荒', CAST(p_partkey % 8 + 1 AS INTEGER), 1) AS a, substring('日月盈昃辰宿列張', CAST(p_partkey % 8 + 1 AS INTEGER), 1) AS b, substring('寒來暑往秋收冬藏', CAST(p_partkey % 8 + 1 AS INTEGER), 1) AS c FROM part)"""


def divided(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("p_partkey") % 8 + 1).cast("int")
    a, b, c = (F.substring(F.lit(w), k, F.lit(1)) for w in ("天地玄黃宇宙洪荒", "日月盈昃辰宿列張", "寒來暑往秋收冬藏"))
    three = F.concat(F.lit("文分為三段。一"), a, F.lit("文、二"), b, F.lit("文、三"), c, F.lit("文。"))
    two = F.concat(F.lit("文分為二段。一"), a, F.lit("文、二"), b, F.lit("文。"))
    body = F.concat(F.lit("初"), a, F.lit("文者，此即是。二"), b, F.lit("文者，亦復然。"))
    text = F.when(F.col("p_partkey") % 4 == 0, F.concat(two, body)).otherwise(F.concat(three, body, F.lit("三"), c, F.lit("文者，如後。")))
    return spread(load(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


@query(f"""WITH {DIVIDED_SQL} SELECT doc_id, 'announce' AS kind, 1 AS n, CASE WHEN two THEN 2 ELSE 3 END AS total, CASE WHEN two THEN a || '文 / ' || b || '文' ELSE a || '文 / ' || b || '文 / ' || c || '文' END AS labels FROM dv
    UNION ALL SELECT doc_id, 'enter', CASE WHEN two THEN 2 ELSE 3 END, CASE WHEN two THEN 3 ELSE 6 END, '' FROM dv""")
def statement_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of announced divisions: per kind how many, the sum of their counts or ordinals, and the labels listed."""
    found = formula.statements_of(divided(spark, sf_dir), formula.CJK)
    number = F.coalesce(F.when(F.col("kind") == "announce", F.col("count")).otherwise(F.col("ordinal")), F.lit(0))
    return found.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum(number).alias("total"), F.array_join(F.flatten(F.collect_list("labels")), " / ").alias("labels"))


@query(f"""WITH {DIVIDED_SQL}, n AS (SELECT doc_id, two, unnest(CASE WHEN two THEN [1, 2] ELSE [1, 2, 3] END) AS sibling, a, b, c FROM dv)
    SELECT doc_id, sibling AS node, sibling, CASE sibling WHEN 1 THEN a WHEN 2 THEN b ELSE c END || '文' AS heading, CASE WHEN two THEN CASE sibling WHEN 1 THEN 14 ELSE 23 END ELSE CASE sibling WHEN 1 THEN 18 WHEN 2 THEN 27 ELSE 36 END END AS char_start FROM n""")
def outline_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines that the statements build: a node a division, placed where it is taken up."""
    return formula.outlines_of(divided(spark, sf_dir), formula.CJK).select("doc_id", "node", "sibling", "heading", "char_start")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'title' WHEN 1000.0 * CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END / n < 0.4 THEN 'sparse' ELSE 'structured' END AS verdict
    FROM (SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 3 = 0 THEN 41 ELSE 20 END + CASE WHEN p_partkey % 7 = 0 THEN 5000 ELSE 0 END AS n FROM part)""")
def genre_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts have no structure to look for: by their title, or by how few announcements a thousand characters hold."""
    k = F.col("p_partkey")
    said = F.when(k % 3 == 0, F.concat(F.lit("文分為二段。一天文、二地文。初天文者，是。二地文者，是。"), F.repeat(F.lit("甲"), 13))).otherwise(F.repeat(F.lit("乙"), 20))
    docs = spread(load(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(k.alias("doc_id"), F.concat(said, F.when(k % 7 == 0, F.repeat(F.lit("丙"), 5000)).otherwise("")).alias("text"), F.when(k % 5 == 0, "音義").otherwise("疏").alias("title"))
    counts = formula.statements_of(docs, formula.CJK).where("kind = 'announce'").groupBy("doc_id").agg(F.count("*").alias("n"))
    density = F.lit(1000.0) * F.coalesce("n", F.lit(0)) / F.col("n_chars")
    return docs.select("doc_id", "title", F.length("text").alias("n_chars")).join(counts, "doc_id", "left").select("doc_id", F.when(F.col("title").rlike("音義$"), "title").when(density < 0.4, "sparse").otherwise("structured").alias("verdict"))


# ---- quotations and labels -------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, 4 AS n, 2 AS deepest, CAST(2 * length(c_name) + 14 AS BIGINT) AS n_chars, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END AS depth_at FROM customer""")
def quotation_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotations of a text, nested ones too, and how deep the first character of the name, or of the inner one, stands."""
    text = F.concat(F.lit("云「"), "c_name", F.lit("『內』」者」，又「"), F.lit("a"), F.lit("」『"), F.lit("b"), F.lit("』「"))
    rows = load(spark, sf_dir, "customer").select("c_custkey", F.length("c_name").alias("m"), quotes.quotation_spans(text).alias("q"))
    at = F.when(F.col("c_custkey") % 2 == 0, F.lit(2)).otherwise(F.col("m") + 3)
    around = F.filter("q", lambda s: (s["start"] < at) & (at < s["end_excl"]))
    n_chars = F.aggregate("q", F.lit(0).cast("bigint"), lambda a, s: a + s["end_excl"] - s["start"])
    return rows.select("c_custkey", F.size("q").cast("bigint").alias("n"), F.array_max(F.transform("q", lambda s: s["depth"])).alias("deepest"), (n_chars + F.col("m")).alias("n_chars"), F.array_max(F.transform(around, lambda s: s["depth"])).alias("depth_at"))


@query("""SELECT s_suppkey, i - 1 AS piece_no, p[i] AS piece FROM (SELECT s_suppkey, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN [s_name, '「x、y」', 'n' || s_nationkey] ELSE [s_name, '〈a、『b、c』〉d'] END AS p FROM supplier))""")
def split_outside_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("s_suppkey") % 2 == 0, F.concat("s_name", F.lit("、「x、y」、n"), F.col("s_nationkey").cast("string"))).otherwise(F.concat("s_name", F.lit("、、〈a、『b、c』〉d")))
    rows = load(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(quotes.split_outside("、")(text)).alias("piece_no", "piece"))
    return rows.withColumn("piece_no", F.col("piece_no").cast("bigint"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name || '三' WHEN 2 THEN p_name WHEN 3 THEN p_name ELSE p_name END AS heading FROM part""")
def headings_without_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings without ordinal, wrapping and bracketed remark; a trailing count goes only if so many were expected."""
    k = F.col("p_partkey") % 5
    raw = F.when(k == 0, F.concat("p_name", F.lit("三"))).when(k == 1, F.concat("p_name", F.lit("三"))).when(k == 2, F.concat(F.lit("【"), "p_name", F.lit("】（二）(x)"))).when(k == 3, F.concat(F.lit("12-3 "), "p_name", F.lit("十二"))).otherwise(F.col("p_name"))
    expected = F.when(k == 0, F.array(F.lit(3), F.lit(9))).when(k == 3, F.array(F.lit(12))).otherwise(F.array(F.lit(4)))
    return load(spark, sf_dir, "part").select("p_partkey", N.bare_heading(raw, expected).alias("heading"))


@query("""SELECT p_partkey, p_name AS subject, CASE WHEN p_partkey % 4 = 0 THEN 'anchor' WHEN p_partkey % 4 = 1 THEN 'pronoun' WHEN p_partkey % 4 = 2 THEN 'struct' ELSE 'term' END AS kind FROM part""")
def subject_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects without opening words, brackets and final particles, and what kind each is."""
    k = F.col("p_partkey") % 4
    prefix = F.element_at(F.array(*map(F.lit, ["今", "此之", "然", "明"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    raw = F.concat(F.lit("「"), prefix, "p_name", F.lit("者"), F.lit("："))
    subject = N.bare_subject(raw)
    kind = first_of([(k == 0, "anchor"), (k == 1, "pronoun"), (k == 2, "struct")], "term")
    return load(spark, sf_dir, "part").select("p_partkey", subject.alias("subject"), kind.alias("kind"))


@query("""SELECT c_custkey, unnest(['system', 'task: root-spans']) AS section, unnest([c_name, c_mktsegment || chr(10) || 'x']) AS body FROM customer""")
def prompt_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a template by their headings; what stands before the first is left out."""
    text = F.concat(F.lit("for people\n## other\n## system \n\n"), "c_name", F.lit("\n\n## task: root-spans\n"), "c_mktsegment", F.lit("\nx\n"))
    parts = F.split(text, r"(?m)^(?=## (?:system|task: [a-z0-9-]+)[ \t]*$)")
    rows = load(spark, sf_dir, "customer").select("c_custkey", F.explode(parts).alias("p")).where(F.col("p").rlike(r"^## (system|task: [a-z0-9-]+)[ \t]*(\n|$)"))
    return rows.select("c_custkey", F.regexp_extract("p", r"^## (system|task: [a-z0-9-]+)", 1).alias("section"), F.regexp_replace(F.regexp_replace("p", r"^[^\n]*\n?", ""), r"^\s+|\s+$", "").alias("body"))


# ---- outlines as text ------------------------------------------------------------------------------------------------


@query("""SELECT o_custkey, o_orderkey, 1 + k % 4 AS level, chr(CAST(64 + 1 + k % 4 AS INTEGER)) AS letters, 'order ' || o_orderkey AS heading, CASE WHEN o_orderkey % 3 = 0 THEN 2 END AS count, CASE WHEN k > 0 AND 1 + k % 4 > 1 + 1 + (k - 1) % 4 THEN true ELSE false END AS skips
    FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders)""")
def labelled_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indented outline lines read back: depth by indent and by the label's letter, heading, count, and whether a level is skipped."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.row_number().over(w) - 1).alias("k")).withColumn("level", 1 + F.col("k") % 4)
    line = F.concat(F.repeat(F.lit("  "), (F.col("level") - 1).cast("int")), F.char(F.col("level") + 64), F.lit("1 order "), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "(2)").otherwise(""))
    read = markup.outline_rows(rows.select(F.struct("o_custkey", "o_orderkey", "k").alias("lineno"), line.alias("value")))
    letters = F.regexp_extract("label", "^([A-Z]+)", 1)
    found = read.select("lineno.*", F.col("level").cast("bigint").alias("level"), letters.alias("letters"), "heading", F.col("count").cast("bigint").alias("count"))
    skips = F.coalesce(F.col("level") > F.lag("level").over(Window.partitionBy("o_custkey").orderBy("k")) + 1, F.lit(False))
    return found.where(N.letter_depth(F.col("letters")) == F.col("level")).withColumn("skips", skips).drop("k")


@query("""WITH l AS (SELECT o_orderkey, o_custkey, 1 + (o_orderkey * 7) % 5 AS level FROM orders), p AS (SELECT a.o_custkey, a.o_orderkey, a.level, max(b.o_orderkey) AS parent FROM l a LEFT JOIN l b ON a.o_custkey = b.o_custkey AND b.o_orderkey < a.o_orderkey AND b.level < a.level GROUP BY ALL)
    SELECT p.o_orderkey, p.level - q.level AS jump FROM p JOIN l q ON q.o_orderkey = p.parent WHERE p.level - q.level > 1""")
def level_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes more than a level below the one that they hang on."""
    rows = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (1 + F.col("o_orderkey") * 7 % 5).alias("level"))
    found = tree.parents_of_levels(rows, ["o_custkey"], "o_orderkey", "level")
    up = rows.select(F.col("o_orderkey").alias("parent_at"), F.col("level").alias("above"))
    return found.join(up, "parent_at").select("o_orderkey", (F.col("level") - F.col("above")).alias("jump")).where("jump > 1")


@query("""WITH l AS (SELECT o_orderkey, o_custkey, 1 + o_orderkey % 4 AS level FROM orders), m AS (SELECT o_custkey, max(o_orderkey) AS last, CAST(floor(avg(o_orderkey)) AS BIGINT) AS first FROM l GROUP BY 1),
    e AS (SELECT a.o_custkey, a.o_orderkey, a.level, coalesce(min(b.o_orderkey) - 1, any_value(m.last)) AS end_at, any_value(m.first) AS first FROM l a JOIN m USING (o_custkey) LEFT JOIN l b ON a.o_custkey = b.o_custkey AND b.o_orderkey > a.o_orderkey AND b.level <= a.level GROUP BY ALL)
    SELECT o_custkey, o_orderkey, level FROM e WHERE o_orderkey < first AND first <= end_at""")
def carried_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units opened before a span that still hold its first line: its ancestors from outside."""
    rows = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (1 + F.col("o_orderkey") % 4).alias("level"))
    ends = rows.groupBy("o_custkey").agg(F.max("o_orderkey").alias("last"), F.floor(F.avg("o_orderkey")).alias("first"))
    found = sequences.unit_ends(rows.join(ends, "o_custkey"), ["o_custkey"], "o_orderkey", "level", F.col("last"))
    return found.where("o_orderkey < first AND first <= end_at").select("o_custkey", "o_orderkey", "level")


@query(f"""WITH {SPANS_SQL} SELECT a.event_id, arg_max(b.event_id, (b.event_id % 5) * 100000000000 + b.event_id) AS holder, max(b.event_id % 5) AS level FROM sp a JOIN sp b ON a.user_id = b.user_id AND b.s <= a.s AND a.s < b.e GROUP BY a.event_id""")
def deepest_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the spans that hold a place, the one at the deepest level."""
    spans = event_spans(spark, sf_dir)
    points = spans.select("event_id", "user_id", F.col("s").alias("at"))
    level = F.col("span_id") % 5
    found = intervals.contained(points, spans.withColumnRenamed("event_id", "span_id"), ["user_id"], "at", "s", "e", 3600)
    return found.groupBy("event_id").agg(F.max_by("span_id", F.struct(level, F.col("span_id"))).alias("holder"), F.max(level).alias("level"))


@query(f"""WITH {CHAINED_SQL}, s AS (SELECT tree, id, parent, k, q AS a, q + (q * 7) % 13 AS b FROM ch), j AS (SELECT s.*, p.a AS pa, p.b AS pb, lag(s.b) OVER (PARTITION BY s.tree, s.parent ORDER BY s.k) AS elder FROM s JOIN s p ON p.id = s.parent)
    SELECT CAST(tree AS VARCHAR) AS tree, id, CASE WHEN a < pa OR b > pb THEN 'outside' WHEN elder IS NOT NULL AND a < elder THEN 'overlap' ELSE 'fits' END AS finding FROM j""")
def child_range_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of children: inside the parent's, in order, at most one line shared with the elder sibling."""
    rows = chained(spark, sf_dir).select("tree", "id", "parent", "ord", F.col("q").alias("a"), (F.col("q") + F.col("q") * 7 % 13).alias("b"))
    up = rows.select(F.col("id").alias("parent"), F.col("a").alias("pa"), F.col("b").alias("pb"))
    elder = F.lag("b").over(Window.partitionBy("tree", "parent").orderBy("ord"))
    both = rows.join(up, "parent").withColumn("elder", elder)
    return both.select("tree", "id", F.when((F.col("a") < F.col("pa")) | (F.col("b") > F.col("pb")), "outside").when(F.col("a") < F.col("elder"), "overlap").otherwise("fits").alias("finding"))


@query(f"""WITH {LINES_SQL}, c AS (SELECT doc_id, unnest([0, 40]) AS a, unnest([20, 60]) AS b FROM documents) SELECT doc_id, count(*) AS n_outside, min(line_no) AS first_line FROM lo WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = lo.doc_id AND lo.char_start >= a AND lo.char_start < b) GROUP BY doc_id""")
def uncovered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that begin in no coverage span."""
    lines = lines_of(spark, sf_dir).select("doc_id", "line_no", "char_start")
    spans = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 20), (40, 60))))).alias("x")).select("doc_id", "x.*")
    held = intervals.contained(lines, spans, ["doc_id"], "char_start", "a", "b").select("doc_id", "line_no").distinct()
    return lines.join(held, ["doc_id", "line_no"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("n_outside"), F.min("line_no").alias("first_line"))


@query("""SELECT CASE WHEN a // 2 <> b // 2 THEN CASE WHEN a < b THEN 'before' ELSE 'after' END WHEN a % 2 = b % 2 THEN 'same' WHEN a % 2 < b % 2 THEN 'before' ELSE 'after' END AS cmp, count(*) AS n FROM (SELECT l_partkey % 20 AS a, l_suppkey % 20 AS b FROM lineitem) GROUP BY 1""")
def folio_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves compared by number, then side: 12a before 12b."""
    leaf = lambda c: F.concat(F.floor(F.col(c) % 20 / 2).cast("string"), F.when(F.col(c) % 2 == 0, "a").otherwise("b"))
    parsed = lambda x: F.struct(F.regexp_extract(x, "^([0-9]+)", 1).cast("int").alias("n"), F.regexp_extract(x, "([ab])$", 1).alias("side"))
    rows = load(spark, sf_dir, "lineitem").select(parsed(leaf("l_partkey")).alias("a"), parsed(leaf("l_suppkey")).alias("b"))
    return rows.groupBy(F.when(F.col("a") < F.col("b"), "before").when(F.col("a") == F.col("b"), "same").otherwise("after").alias("cmp")).agg(F.count("*").alias("n"))


# ---- records as text and back ----------------------------------------------------------------------------------------


@query("""SELECT conv_id, turn, role, length(text) AS n FROM conversations WHERE turn % 4 <> 3""")
def torn_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines read back, every fourth of them torn: what can't be parsed is left out."""
    whole = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    lines = load(spark, sf_dir, "conversations").select(F.when(F.col("turn") % 4 == 3, F.substring(whole, 1, 20)).otherwise(whole).alias("line"))
    read = lines.select(F.from_json("line", "conv_id bigint, turn bigint, role string, text string, torn string", {"columnNameOfCorruptRecord": "torn"}).alias("x")).select("x.*")
    return read.where("torn IS NULL").select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("n"))


@query("""SELECT page_id, url || chr(9) || CAST(length(html) AS VARCHAR) || chr(9) || sha256(html) AS line, 3 AS n_fields FROM pages""")
def tsv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws("\t", "url", F.length("html").cast("string"), F.sha2("html", 256))
    return load(spark, sf_dir, "pages").select("page_id", line.alias("line"), F.size(F.split(line, "\t")).cast("bigint").alias("n_fields"))


@query("""SELECT doc_id, 1 + (length(text) - 1) // 300 AS n_chunks, length(text) AS n_chars, sha256(text) AS digest FROM documents WHERE text <> ''""")
def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with a marker before each, written as one markdown text and read back: how many there are, and the text again."""
    docs = load(spark, sf_dir, "documents").where("text <> ''").select("doc_id", "text")
    n = F.floor((F.length("text") - 1) / 300).cast("int")
    chunk = lambda k: F.concat(F.lit("["), k.cast("string"), F.lit(") chunk]\n"), F.substring("text", k * 300 + 1, F.lit(300)), F.lit("\n\x1e\n"))
    written = docs.select("doc_id", F.array_join(F.transform(F.sequence(F.lit(0), n), chunk), "").alias("md"))
    parts = F.filter(F.split("md", "\n\x1e\n"), lambda x: x != "")
    read = written.select("doc_id", F.transform(parts, lambda x: F.struct(N.parse_marker(F.substring_index(x, "\n", 1))["indicator"].alias("k"), F.substring(x, F.length(F.substring_index(x, "\n", 1)) + 2, F.length(x)).alias("t"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["t"]), "")
    return read.select("doc_id", F.size(F.array_distinct(F.transform("p", lambda x: x["k"]))).cast("bigint").alias("n_chunks"), F.length(text).cast("bigint").alias("n_chars"), F.sha2(text, 256).alias("digest"))


@query("""WITH s AS (SELECT 'orders' AS stage, count(*) AS n, max(o_orderkey) AS last FROM orders UNION ALL SELECT 'lineitem', count(*), max(l_orderkey) FROM lineitem UNION ALL SELECT 'customer', count(*), max(c_custkey) FROM customer) SELECT stage, n, sha256(stage || ':' || n || ':' || last) AS input_hash FROM s""")
def run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per stage how many rows it read, and a hash that names its input."""
    one = lambda t, k: load(spark, sf_dir, t).agg(F.lit(t).alias("stage"), F.count("*").alias("n"), F.max(k).alias("last"))
    stages = one("orders", "o_orderkey").unionByName(one("lineitem", "l_orderkey")).unionByName(one("customer", "c_custkey"))
    return stages.select("stage", "n", F.sha2(F.concat_ws(":", "stage", "n", "last"), 256).alias("input_hash"))


@query(f"""WITH {NODES_SQL.strip().rstrip(',')}, o AS (SELECT id, sha256(heading) AS k FROM nodes WHERE ord % 9 <> 0), n AS (SELECT 'new-' || id AS id, sha256(CASE WHEN ord % 10 = 3 THEN heading || '!' ELSE heading END) AS k FROM nodes WHERE ord % 8 <> 0)
    SELECT CASE WHEN o.k IS NULL THEN 'minted' WHEN n.k IS NULL THEN 'gone' ELSE 'kept' END AS state, count(*) AS n FROM o FULL JOIN n ON o.k = n.k GROUP BY 1""")
def id_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ids of an export live on in the next, by content keys."""
    rows, o = nodes_of(spark, sf_dir), F.col("ord")
    old = rows.where(o % 9 != 0).select(F.sha2("heading", 256).alias("k"), F.col("id").alias("a"))
    new = rows.where(o % 8 != 0).select(F.sha2(F.when(o % 10 == 3, F.concat("heading", F.lit("!"))).otherwise(F.col("heading")), 256).alias("k"), F.concat(F.lit("new-"), "id").alias("b"))
    state = F.when(F.col("a").isNull(), "minted").when(F.col("b").isNull(), "gone").otherwise("kept")
    return old.join(new, "k", "full").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT o_orderkey AS k, sha256('req' || o_orderkey) AS h FROM orders), a AS (SELECT h, arg_max(v, v) AS answer, count(*) AS n FROM (SELECT sha256('req' || l_orderkey) AS h, l_partkey AS v FROM lineitem WHERE l_linenumber > 3) GROUP BY h)
    SELECT k, CASE WHEN answer IS NULL THEN 'pending' ELSE 'answered' END AS state, answer FROM r LEFT JOIN a USING (h)""")
def replayed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests joined by hash to recorded answers, of which the last wins; the others are pending."""
    hash_of = lambda c: F.sha2(F.concat(F.lit("req"), F.col(c).cast("string")), 256).alias("h")
    requests = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), hash_of("o_orderkey"))
    answers = load(spark, sf_dir, "lineitem").where("l_linenumber > 3").select(hash_of("l_orderkey"), "l_partkey").groupBy("h").agg(F.max("l_partkey").alias("answer"))
    return requests.join(answers, "h", "left").select("k", F.when(F.col("answer").isNull(), "pending").otherwise("answered").alias("state"), "answer")


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'fits' WHEN 1 THEN 'span: not a number; start: missing' ELSE 'not an object' END AS finding FROM conversations""")
def answer_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers against a schema: what is missing or of another kind, in order of the fields."""
    k = F.col("turn") % 3
    answer = F.when(k == 0, F.concat(F.lit('{"start":'), F.col("turn").cast("string"), F.lit(',"span":2}'))).when(k == 1, '{"span":"x"}').otherwise("[1]")
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", answer.alias("a"))
    field = lambda name: F.get_json_object("a", f"$.{name}")
    fault = lambda name: F.when(field(name).isNull(), f"{name}: missing").when(field(name).try_cast("double").isNull(), f"{name}: not a number")
    faults = F.concat_ws("; ", fault("span"), fault("start"))
    return rows.select("conv_id", "turn", F.when(~F.col("a").rlike(r"^\s*\{"), "not an object").when(faults == "", "fits").otherwise(faults).alias("finding"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN bad THEN NULL ELSE a END AS start, CASE WHEN bad THEN NULL ELSE b END AS "end", CASE WHEN bad THEN 'nulled: was ' || a || '..' || b END AS note
    FROM (SELECT *, b < a AS bad FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT) AS a, l_suppkey % 50 AS b FROM lineitem))""")
def nulled_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that would run backwards are nulled, and what they were is noted."""
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.struct(F.col("l_quantity").cast("bigint").alias("start"), (F.col("l_suppkey") % 50).alias("end")).alias("x"))
    bad = F.col("x.end") < F.col("x.start")
    null = F.lit(None).cast("bigint")
    fixed = rows.withColumn("note", F.when(bad, F.format_string("nulled: was %d..%d", "x.start", "x.end"))).withColumn("x", F.when(F.col("note").isNotNull(), F.col("x").withField("start", null).withField("end", null)).otherwise(F.col("x")))
    return fixed.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "x.start", "x.end", "note")


@query(f"""WITH {LINES_SQL}, s AS (SELECT doc_id, line_no, CASE WHEN line_no % 5 = 0 THEN NULL ELSE line_no END AS root, doc_id % 2 = 0 AND line_no BETWEEN 1 AND 6 AS read_ FROM lo) SELECT doc_id, min(root) FILTER (read_) AS first, max(root) FILTER (read_) AS last FROM s GROUP BY doc_id HAVING count(*) FILTER (read_) > 0""")
def covered_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first to the last root line of the nodes that were read from a run's span."""
    rows = lines_of(spark, sf_dir).where((F.col("doc_id") % 2 == 0) & F.col("line_no").between(1, 6))
    root = F.when(F.col("line_no") % 5 != 0, F.col("line_no"))
    return rows.groupBy("doc_id").agg(F.min(root).alias("first"), F.max(root).alias("last"))


@query("""SELECT p_brand, p_size, coalesce(CASE WHEN p_size % 3 = 0 THEN p_partkey END, CASE WHEN p_size % 3 = 1 THEN p_partkey * 2 END, -1) AS start FROM (SELECT p_brand, p_size, min(p_partkey) AS p_partkey FROM part GROUP BY ALL)""")
def part_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a declared part starts: its first chapter's line, else its first child's, else nowhere."""
    firsts = load(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("k"))
    return firsts.select("p_brand", "p_size", F.coalesce(F.when(F.col("p_size") % 3 == 0, F.col("k")), F.when(F.col("p_size") % 3 == 1, F.col("k") * 2), F.lit(-1)).alias("start"))


@query("""SELECT o_orderpriority, max(CASE WHEN o_orderstatus = 'F' THEN n END) || ' / ' || max(CASE WHEN o_orderstatus = 'O' THEN n END) AS cells, CAST(sum(n) AS BIGINT) AS n FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_orderpriority""")
def guide_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a generated table: counts by status, written side by side."""
    found = load(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(*(F.count_if(F.col("o_orderstatus") == s).alias(s) for s in "FO"), F.count("*").alias("n"))
    return found.select("o_orderpriority", F.format_string("%d / %d", "F", "O").alias("cells"), "n")
