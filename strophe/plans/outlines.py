"""Queries on outline nodes: locators and kinds, inherited and tiled spans, chains, sequences of lines, and the scorer's counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import nodes as N
from ..operators import outlines, sequences, tree
from .relations import NODES_SQL, SPANS_SQL, WALK_SQL, event_spans, nodes_of
from .tables import load
from .texts import LINES_SQL, lines_of

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# ---- locators and kinds of nodes -------------------------------------------------------------------------------------

#: Lines of orders as nodes with locators: announced on a line of the part, explained there or on the supplier's.
LOCATED_SQL = """loc AS (SELECT *, CASE WHEN q % 6 = 0 THEN NULL WHEN q % 6 = 1 THEN '' ELSE 'T01n' || l_partkey || '_p0001a01:' || q END AS announced,
    CASE WHEN q % 4 = 0 THEN NULL WHEN q % 4 = 1 THEN 'T01n' || l_suppkey || '_p0002b03' ELSE 'T01n' || l_partkey || '_p0001a01:' || q END AS explained,
    CASE WHEN q % 5 = 0 THEN 'T09n' || l_orderkey || '_p0003c05' END AS root_start, CASE WHEN q % 3 = 0 THEN 'commentary-internal' ELSE 'sutra-span' END AS node_class,
    CASE WHEN q % 7 = 0 THEN ['seen', 'out of span: ' || q] WHEN q % 7 = 1 THEN ['was out of span'] END AS notes FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem))"""


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, text = F.col("q"), lambda c: F.col(c).cast("string")
    part = F.concat(F.lit("T01n"), text("l_partkey"), F.lit("_p0001a01:"), text("q"))
    return load(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("bigint")).withColumns({
        "announced": F.when(q % 6 == 0, None).when(q % 6 == 1, "").otherwise(part),
        "explained": F.when(q % 4 == 0, None).when(q % 4 == 1, F.concat(F.lit("T01n"), text("l_suppkey"), F.lit("_p0002b03"))).otherwise(part),
        "root_start": F.when(q % 5 == 0, F.concat(F.lit("T09n"), text("l_orderkey"), F.lit("_p0003c05"))),
        "node_class": F.when(q % 3 == 0, "commentary-internal").otherwise("sutra-span"),
        "notes": F.when(q % 7 == 0, F.array(F.lit("seen"), F.concat(F.lit("out of span: "), text("q")))).when(q % 7 == 1, F.array(F.lit("was out of span"))),
    })


@query(f"""WITH {LOCATED_SQL} SELECT l_orderkey, l_partkey, l_suppkey, q, CASE WHEN l_linenumber % 2 = 0 AND q % 3 <> 0 THEN explained WHEN q % 3 = 0 THEN announced END AS key_line,
    coalesce(nullif(announced, ''), nullif(explained, ''), nullif(root_start, '')) AS marker FROM loc""")
def key_and_marker_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = F.col("q") % 3 == 0
    key = N.key_line(F.when(has, F.col("announced")), has, F.col("explained"), F.col("l_linenumber") % 2 == 0)
    return located(spark, sf_dir).select("l_orderkey", "l_partkey", "l_suppkey", "q", key.alias("key_line"), N.marker_locator(F.col("announced"), F.col("explained"), F.col("root_start")).alias("marker"))


KIND_SQL = "CASE WHEN coalesce(announced = explained AND contains(announced, ':'), false) THEN 'listed_only' WHEN node_class = 'commentary-internal' THEN 'commentary_internal' ELSE 'taken_up' END"


@query(f"WITH {LOCATED_SQL} SELECT l_returnflag, {KIND_SQL} AS kind, count(*) AS n FROM loc GROUP BY ALL")
def node_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return located(spark, sf_dir).groupBy("l_returnflag", N.node_kind(F.col("announced"), F.col("explained"), F.col("node_class")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"WITH {LOCATED_SQL} SELECT l_orderkey, count(*) FILTER (coalesce(len(list_filter(notes, lambda x: starts_with(x, 'out of span'))) > 0, false)) AS n_out, count(*) AS n FROM loc GROUP BY l_orderkey")
def out_of_span_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return located(spark, sf_dir).groupBy("l_orderkey").agg(F.count_if(N.out_of_span(F.col("notes"))).alias("n_out"), F.count("*").alias("n"))


@query("""SELECT c_custkey, substring('甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥', lv, 1) || CASE WHEN t = 0 THEN '' WHEN t = 1 THEN '十' ELSE substring('一二三四五六七八九', t, 1) || '十' END || CASE WHEN u = 0 THEN '' ELSE substring('一二三四五六七八九', u, 1) END AS label,
    CASE WHEN lv <= 3 THEN '1-3' WHEN lv <= 6 THEN '4-6' WHEN lv <= 9 THEN '7-9' WHEN lv <= 12 THEN '10-12' ELSE '13+' END AS band,
    sib || translate(CAST(lv AS VARCHAR), '0123456789', '₀₁₂₃₄₅₆₇₈₉') || '2₁₁' AS shown
    FROM (SELECT c_custkey, c_custkey % 24 + 1 AS lv, c_custkey % 99 + 1 AS sib, (c_custkey % 99 + 1) // 10 AS t, (c_custkey % 99 + 1) % 10 AS u FROM customer) WHERE lv <= 22
    UNION ALL SELECT c_custkey, NULL, '13+', (c_custkey % 99 + 1) || translate(CAST(c_custkey % 24 + 1 AS VARCHAR), '0123456789', '₀₁₂₃₄₅₆₇₈₉') || '2₁₁' FROM customer WHERE c_custkey % 24 + 1 > 22""")
def level_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    level, sibling = F.col("c_custkey") % 24 + 1, F.col("c_custkey") % 99 + 1
    path = F.array(F.concat(sibling.cast("string"), F.lit("_"), level.cast("string")), F.lit("2_11"))
    return load(spark, sf_dir, "customer").select("c_custkey", N.level_label(level, sibling).alias("label"), N.depth_band(level).alias("band"), N.indicator(path).alias("shown"))


@query(r"""SELECT s_suppkey, trim(regexp_replace(h, '^[0-9]+(-[0-9]+)?\s', '')) AS heading, CASE WHEN s_suppkey % 5 = 0 THEN 'X' || s_suppkey ELSE 'T' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') END AS work,
    CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 26 + 1 WHEN s_suppkey % 3 = 1 THEN s_suppkey % 26 + 27 END AS depth
    FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey || '-2 ' WHEN s_suppkey % 3 = 1 THEN s_suppkey || ' ' ELSE 'no' || s_suppkey || ' ' END || s_name AS h FROM supplier)""")
def heading_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, text = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    heading = F.concat(F.when(k % 3 == 0, F.concat(text, F.lit("-2 "))).when(k % 3 == 1, F.concat(text, F.lit(" "))).otherwise(F.concat(F.lit("no"), text, F.lit(" "))), "s_name")
    file = F.when(k % 5 == 0, F.concat(F.lit("X"), text)).otherwise(F.concat(F.lit("T09n"), F.lpad(text, 4, "0")))
    letters = F.when(k % 3 == 0, F.char(k % 26 + 65)).when(k % 3 == 1, F.char(k % 26 + 97)).otherwise("ab")
    return load(spark, sf_dir, "supplier").select("s_suppkey", N.strip_ordinal(heading).alias("heading"), N.short_work(file).alias("work"), N.letter_depth(letters).cast("bigint").alias("depth"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_partkey WHEN 1 THEN 7 WHEN 2 THEN 10 WHEN 3 THEN 14 WHEN 4 THEN 83 END AS value FROM part""")
def count_tokens_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    token = F.when(k == 0, F.col("p_partkey").cast("string")).when(k == 1, "七").when(k == 2, "十").when(k == 3, "十四").when(k == 4, "八十三").otherwise(F.element_at(F.array(F.lit("二三"), F.lit("百五"), F.lit("x")), (F.col("p_partkey") % 3 + 1).cast("int")))
    return load(spark, sf_dir, "part").select("p_partkey", N.count_value(token).alias("value"))


@query(f"""WITH {LINES_SQL}, n AS (SELECT doc_id, max(line_no) AS last FROM lo GROUP BY doc_id), sp AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE last // 3 END AS a, CASE WHEN doc_id % 3 = 0 THEN last WHEN doc_id % 3 = 1 THEN 2 * last // 3 ELSE last END AS b FROM n)
    SELECT lo.doc_id, count(*) AS n_lines, CAST(sum(n) AS BIGINT) AS n_chars, min(line_no) AS first_line, max(line_no) AS last_line FROM lo JOIN sp ON lo.doc_id = sp.doc_id AND line_no BETWEEN a AND b GROUP BY lo.doc_id""")
def span_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document's span: the whole, a spec A..B, or a named split, the last two thirds."""
    lines = lines_of(spark, sf_dir)
    ends = lines.groupBy("doc_id").agg(F.max("line_no").alias("last"))
    third = F.floor(F.col("last") / 3)
    spec = F.when(F.col("doc_id") % 3 == 0, "whole").when(F.col("doc_id") % 3 == 1, F.concat(third.cast("string"), F.lit(".."), F.floor(2 * F.col("last") / 3).cast("string"))).otherwise("test")
    known = ends.withColumn("e", N.span_ends(spec)).withColumn("spec", spec)
    spans = known.select("doc_id", F.coalesce(F.col("e.first").cast("bigint"), F.when(F.col("spec") == "test", third).otherwise(0)).alias("a"), F.coalesce(F.col("e.last").cast("bigint"), F.col("last")).alias("b"))
    held = lines.join(spans, "doc_id").where(F.col("line_no").between(F.col("a"), F.col("b")))
    return held.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


@query("""SELECT c_custkey, i - 1 AS split_no, substring(s, 1, p[i] - 1) AS a, substring(s, p[i] + 1) AS b FROM (SELECT c_custkey, s, p, unnest(range(1, len(p) + 1)) AS i FROM (
    SELECT c_custkey, s, list_filter(range(2, length(s)), lambda i: substring(s, i, 1) = '至') AS p FROM (SELECT c_custkey, replace(c_name, '#', '至') || CASE WHEN c_custkey % 3 = 0 THEN '至x' ELSE '' END AS s FROM customer)))
    UNION ALL SELECT c_custkey, 0, c_name, NULL FROM customer WHERE NOT contains(c_name, '#') AND c_custkey % 3 <> 0""")
def lemma_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.replace(F.col("c_name"), F.lit("#"), F.lit("至")), F.when(F.col("c_custkey") % 3 == 0, "至x").otherwise(""))
    rows = load(spark, sf_dir, "customer").select("c_custkey", F.posexplode(N.lemma_parts(raw)).alias("split_no", "x"))
    return rows.select("c_custkey", F.col("split_no").cast("bigint").alias("split_no"), "x.a", "x.b")


@query(f"""WITH {LOCATED_SQL} SELECT l_orderkey, l_partkey, l_suppkey, q, '[' || q || '₁) part ' || l_partkey || CASE WHEN coalesce(announced, '') <> '' THEN ' ' || announced ELSE '' END || ']' AS line, CAST(q AS VARCHAR) || '₁' AS indicator, 'part ' || l_partkey AS heading, nullif(announced, '') AS locator FROM loc""")
def marker_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers written as lines and read back."""
    line = N.marker_line(F.concat(F.col("q").cast("string"), F.lit("₁")), F.concat(F.lit("part "), F.col("l_partkey").cast("string")), F.col("announced"))
    rows = located(spark, sf_dir).select("l_orderkey", "l_partkey", "l_suppkey", "q", line.alias("line"))
    return rows.withColumn("x", N.parse_marker(F.col("line"))).select("l_orderkey", "l_partkey", "l_suppkey", "q", "line", "x.indicator", "x.heading", "x.locator")


@query("""SELECT CASE p_partkey % 9 WHEN 0 THEN 'lemma' WHEN 1 THEN 'lemma' WHEN 2 THEN 'dialog' WHEN 3 THEN 'question' WHEN 4 THEN 'citation' WHEN 5 THEN 'citation' WHEN 6 THEN 'lemma' ELSE CASE WHEN length(p_name) + 2 <= 14 THEN 'term' ELSE 'citation' END END AS kind,
    count(*) AS n, CAST(sum(length(p_name)) AS BIGINT) AS n_chars FROM part GROUP BY 1""")
def quotation_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotations found in a text by their marks, each with the four characters before it and the three after."""
    k = (F.col("p_partkey") % 9).cast("int")
    before = F.element_at(F.array(*map(F.lit, ["故經：", "始從", "論答曰：", "問：", "彼云：", "說", "此", "此", "此"])), k + 1)
    after = F.element_at(F.array(*map(F.lit, ["者", "者", "者", "者", "者", "者", "已下文", "者", "。"])), k + 1)
    text = F.concat(before, F.lit("「"), "p_name", F.lit("」"), after)
    parts = lambda g: F.regexp_extract("t", "(.{0,4})「([^」]*)」(.{0,3})", g)
    rows = load(spark, sf_dir, "part").select("p_name", text.alias("t"))
    kinds = rows.select(N.quote_kind(parts(1), parts(3), F.length(parts(2)) + 2).alias("kind"), F.length("p_name").alias("n"))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"), F.sum("n").alias("n_chars"))


@query(r"""SELECT doc_id, regexp_matches(t, '[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}]') AS has_private, len(regexp_extract_all(t, '[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}]')) AS n_private
    FROM (SELECT doc_id, text || CASE WHEN doc_id % 4 = 0 THEN chr(57345) || 'x' || chr(983041) ELSE 'x' END AS t FROM documents)""")
def private_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat("text", F.when(F.col("doc_id") % 4 == 0, "\ue001x\U000f0001").otherwise("x"))
    return load(spark, sf_dir, "documents").select("doc_id", N.has_private(t).alias("has_private"), F.regexp_count(t, F.lit(N.PRIVATE)).cast("bigint").alias("n_private"))


# ---- trees -----------------------------------------------------------------------------------------------------------

PLAIN_NODES = NODES_SQL.strip().rstrip(",")


@query(f"""WITH RECURSIVE {PLAIN_NODES}, f AS (SELECT *, parent IS NOT NULL AND row_number() OVER (PARTITION BY tree, parent ORDER BY ord, id) = 1 AS fst, (ord * 7) % 1000 AS ex, left(id, 1) = 'r' AND ord % 2 = 0 AS ed FROM nodes),
    w AS (SELECT id, ex AS st, ed, false AS inh FROM f WHERE parent IS NULL UNION ALL SELECT f.id, CASE WHEN f.fst AND NOT w.ed AND w.st >= 7 THEN w.st ELSE f.ex END, f.ed, f.fst AND NOT w.ed AND w.st >= 7 FROM f JOIN w ON f.parent = w.id)
    SELECT id, st AS span_start, inh AS inherited FROM w""")
def inherited_span_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = nodes_of(spark, sf_dir).withColumns({"explained": F.col("ord") * 7 % 1000, "editorial": (F.substring("id", 1, 1) == "r") & (F.col("ord") % 2 == 0)})
    return outlines.span_starts(nodes, 7).drop("tree")


@query(f"""WITH RECURSIVE {PLAIN_NODES}, w AS (SELECT id, ord % 3 <> 1 AS ok, CASE WHEN ord % 3 <> 1 THEN id END AS last, CAST(NULL AS VARCHAR) AS above FROM nodes WHERE parent IS NULL
    UNION ALL SELECT n.id, n.ord % 3 <> 1, CASE WHEN n.ord % 3 <> 1 THEN n.id ELSE w.last END, w.last FROM nodes n JOIN w ON n.parent = w.id) SELECT id, above AS parent FROM w WHERE ok""")
def scored_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlines.scored_parents(nodes_of(spark, sf_dir), F.when(F.col("ord") % 3 != 1, F.col("ord"))).drop("tree")


@query(f"""WITH {PLAIN_NODES}, l AS (SELECT id, parent, k % 4 = 0 OR k IN (1, 2, 3, 17, 24) AS m FROM (SELECT id, parent, CAST(substring(parent, 2) AS INTEGER) AS k FROM nodes WHERE left(id, 1) IN ('s', 'c'))),
    n AS (SELECT x.id, x.parent, coalesce(bool_and(l.m) AND count(l.id) >= 2, false) AS m FROM nodes x LEFT JOIN l ON l.parent = x.id WHERE left(x.id, 1) = 'n' GROUP BY x.id, x.parent),
    r AS (SELECT x.id, coalesce(bool_and(n.m) AND count(n.id) >= 2, false) AS m FROM nodes x LEFT JOIN n ON n.parent = x.id WHERE left(x.id, 1) = 'r' GROUP BY x.id)
    SELECT id, m AS marked FROM l UNION ALL SELECT id, m FROM n UNION ALL SELECT id, m FROM r""")
def marked_divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.substring("id", 1, 1) == "r", 1).when(F.substring("id", 1, 1) == "n", 2).otherwise(3)
    above = F.substring("parent", 2, 9).cast("int")
    return outlines.by_level_up(nodes_of(spark, sf_dir).withColumn("level", level), (F.col("level") == 3) & ((above % 4 == 0) | above.isin(1, 2, 3, 17, 24))).drop("tree")


STARTS_SQL = """st AS (SELECT num.*, "order" * 10 - CASE WHEN "order" % 11 = 0 THEN 25 ELSE 0 END AS s FROM num)"""


def started(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tree.numbered(nodes_of(spark, sf_dir))
    return rows.withColumn("ord", F.col("sibling_index")).withColumn("start", F.col("order") * 10 - F.when(F.col("order") % 11 == 0, 25).otherwise(0))


@query(WALK_SQL + f""", {STARTS_SQL}, nx AS (SELECT *, lead(s) OVER (PARTITION BY tree, parent ORDER BY sibling_index) - 1 AS nxt FROM st),
    te AS (SELECT id, CASE WHEN coalesce(nxt, 100000000) < s THEN s ELSE least(coalesce(nxt, 100000000), 100000000) END AS e, coalesce(nxt, 100000000) AS t FROM nx WHERE parent IS NULL
    UNION ALL SELECT nx.id, CASE WHEN coalesce(nxt, te.e) < s THEN s ELSE least(coalesce(nxt, te.e), te.e) END, coalesce(nxt, te.e) FROM nx JOIN te ON nx.parent = te.id)
    SELECT id, e AS "end", e <> t AS clamped FROM te""")
def tiled_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlines.tiled_ends(started(spark, sf_dir), F.lit(100_000_000).cast("bigint")).drop("tree")


@query(WALK_SQL + f""", {STARTS_SQL}, sp AS (SELECT id, tree, parent, sibling_index, CASE WHEN "order" % 7 <> 0 THEN s END AS a, CASE WHEN "order" % 7 <> 0 AND "order" % 5 <> 0 THEN s + 40 END AS b FROM st),
    sb AS (SELECT *, max(coalesce(b, a)) OVER (PARTITION BY tree, parent ORDER BY sibling_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS elder, first_value(a IGNORE NULLS) OVER (PARTITION BY tree, parent ORDER BY sibling_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS younger FROM sp),
    ad AS (SELECT id, CAST(0 AS BIGINT) AS lo, CAST(1000000 AS BIGINT) AS hi, greatest(0, a) AS lo2, least(1000000, b) AS hi2, elder, younger FROM sb WHERE parent IS NULL
    UNION ALL SELECT sb.id, ad.lo2, ad.hi2, greatest(ad.lo2, sb.a), least(ad.hi2, sb.b), sb.elder, sb.younger FROM sb JOIN ad ON sb.parent = ad.id) SELECT id, greatest(lo, elder) AS lo, least(hi, younger) AS hi FROM ad""")
def admissible_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = F.col("order") % 7 != 0
    rows = started(spark, sf_dir).withColumn("end", F.when(has & (F.col("order") % 5 != 0), F.col("start") + 40)).withColumn("start", F.when(has, F.col("start")))
    return outlines.admissible(rows, 1_000_000).drop("tree")


CHAINED_SQL = """ln AS (SELECT l_orderkey AS tree, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS k, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
    ch AS (SELECT tree, tree || '-' || k AS id, CASE WHEN k > 1 THEN tree || '-' || CASE WHEN q % 3 = 0 THEN 1 ELSE k - 1 END END AS parent, k, q FROM ln)"""


def chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order, each below the one before or, every third quantity, below the first."""
    w = Window.partitionBy("tree").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    rows = load(spark, sf_dir, "lineitem").withColumn("tree", F.col("l_orderkey").cast("string")).select("tree", F.row_number().over(w).cast("bigint").alias("ord"), F.col("l_quantity").cast("bigint").alias("q"))
    name = lambda k: F.concat("tree", F.lit("-"), k.cast("string"))
    return rows.select("tree", name(F.col("ord")).alias("id"), F.when(F.col("ord") > 1, name(F.when(F.col("q") % 3 == 0, 1).otherwise(F.col("ord") - 1))).alias("parent"), "ord", "q")


@query(f"""WITH RECURSIVE {CHAINED_SQL}, kd AS (SELECT parent AS id, count(*) AS n FROM ch WHERE parent IS NOT NULL GROUP BY parent), sg AS (SELECT ch.*, coalesce(kd.n = 1, false) AS one FROM ch LEFT JOIN kd USING (id)),
    w AS (SELECT id, id AS head, CAST(1 AS BIGINT) AS pos, one FROM sg WHERE parent IS NULL UNION ALL SELECT sg.id, CASE WHEN w.one THEN w.head ELSE sg.id END, CASE WHEN w.one THEN w.pos + 1 ELSE 1 END, sg.one FROM sg JOIN w ON sg.parent = w.id) SELECT head AS id, max(pos) AS length FROM w GROUP BY head""")
def single_child_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlines.single_chains(chained(spark, sf_dir)).drop("tree")


@query(WALK_SQL + """, o AS (SELECT num.*, nodes.ord FROM num JOIN nodes USING (id)) SELECT a.id, min(b.ord) AS least, max(b.ord) AS most FROM o a JOIN o b ON b.path = a.path OR starts_with(b.path, a.path || '.') GROUP BY a.id""")
def subtree_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = nodes_of(spark, sf_dir)
    return outlines.least_below(tree.numbered(nodes).join(nodes.select("tree", "id", "ord"), ["tree", "id"]), "ord").drop("tree")


@query(WALK_SQL + """SELECT a.id AS above, b.id AS below, b.level - a.level AS depth FROM num a JOIN num b ON starts_with(b.path, a.path || '.') WHERE left(b.id, 1) = 's'""")
def tree_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with every node above them: each row's path names its ancestors, so the join is one on equal paths."""
    rows = tree.numbered(nodes_of(spark, sf_dir))
    cut = F.expr("transform(sequence(1, size(split(path, '[.]')) - 1), k -> array_join(slice(split(path, '[.]'), 1, k), '.'))")
    below = rows.where("left(id, 1) = 's'").select("tree", F.col("id").alias("below"), F.col("level").alias("l"), F.explode(cut).alias("path"))
    above = rows.select("tree", "path", F.col("id").alias("above"), "level")
    return below.join(above, ["tree", "path"]).select("above", "below", (F.col("l") - F.col("level")).alias("depth"))


@query(WALK_SQL + """SELECT b.id, b."order" FROM siz a JOIN num b ON b."order" BETWEEN a."order" AND a."order" + a.size - 1 WHERE a.id = 'n3'""")
def subtree_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tree.numbered(nodes_of(spark, sf_dir))
    top = tree.subtree_sizes(rows).where("id = 'n3'").select(F.col("order").alias("a"), (F.col("order") + F.col("size") - 1).alias("b"))
    return rows.join(F.broadcast(top), F.col("order").between(F.col("a"), F.col("b"))).select("id", "order")


@query(f"""WITH {PLAIN_NODES}, h AS (SELECT id, sha256(coalesce(parent, '') || '|' || heading) AS f FROM nodes WHERE ord % 2 = 0), k AS (SELECT id, sha256(coalesce(parent, '') || '|' || CASE WHEN ord % 10 = 0 THEN lower(heading) ELSE heading END) AS f FROM nodes WHERE ord % 2 = 0)
    SELECT h.id FROM h JOIN k USING (id) WHERE h.f <> k.f""")
def changed_explicit_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit nodes whose fingerprint isn't what it was before an edit."""
    print_of = lambda heading: F.sha2(F.concat(F.coalesce("parent", F.lit("")), F.lit("|"), heading), 256).alias("f")
    rows = nodes_of(spark, sf_dir).where("ord % 2 = 0")
    edited = F.when(F.col("ord") % 10 == 0, F.lower("heading")).otherwise(F.col("heading"))
    return rows.select("id", print_of(F.col("heading"))).exceptAll(rows.select("id", print_of(edited))).select("id")


@query(f"""WITH {PLAIN_NODES}, u AS (SELECT parent, ord % 1000 AS key, 0 AS source, id FROM nodes WHERE left(id, 1) = 's' UNION ALL SELECT parent, ord % 1000, 1, id FROM nodes WHERE left(id, 1) = 'c') SELECT id, row_number() OVER (PARTITION BY parent ORDER BY key, source, id) AS sibling FROM u""")
def merged_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sorted runs of children made one; of equal keys the existing one comes first."""
    rows = nodes_of(spark, sf_dir).where("left(id, 1) IN ('s', 'c')").withColumns({"key": F.col("ord") % 1000, "source": F.when(F.substring("id", 1, 1) == "s", 0).otherwise(1)})
    return rows.select("id", F.row_number().over(Window.partitionBy("parent").orderBy("key", "source", "id")).cast("bigint").alias("sibling"))


@query(f"""WITH RECURSIVE {PLAIN_NODES}, w AS (SELECT id, id AS q FROM nodes WHERE parent IS NULL UNION ALL SELECT n.id, CASE WHEN left(n.id, 1) = 'n' AND n.ord % 3 = 0 THEN n.id ELSE w.q END FROM nodes n JOIN w ON n.parent = w.id)
    SELECT o_orderkey, q AS attached FROM orders LEFT JOIN w ON w.id = 'c' || o_custkey""")
def deepest_ancestor_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.substring("id", 1, 1)
    placed = load(spark, sf_dir, "orders").select("o_orderkey", F.lit("geo").alias("tree"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id"))
    return outlines.deepest_ancestors(placed, nodes_of(spark, sf_dir), (kind == "r") | ((kind == "n") & (F.col("ord") % 3 == 0))).select("o_orderkey", "attached")


# ---- what a scorer counts --------------------------------------------------------------------------------------------


@query(f"""WITH {PLAIN_NODES}, g AS (SELECT id, parent, ord * 10 AS line, NOT (ord % 5 = 0 OR id IN ('n1', 'r2')) AS hit FROM nodes), fr AS (SELECT ord * 10 + 1 AS line FROM nodes WHERE ord % 10 = 0)
    SELECT g.id, CASE WHEN g.parent IS NOT NULL AND NOT p.hit THEN 'cascaded' WHEN EXISTS (SELECT 1 FROM fr WHERE fr.line = g.line + 1) THEN 'frontier_detected' ELSE 'frontier' END AS kind FROM g LEFT JOIN g p ON p.id = g.parent WHERE NOT g.hit""")
def fn_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nodes_of(spark, sf_dir)
    gold = rows.select("tree", "id", "parent", (F.col("ord") * 10).alias("line"))
    matched = rows.where("NOT (ord % 5 = 0 OR id IN ('n1', 'r2'))").select("tree", F.col("id").alias("gold_id"))
    free = rows.where("ord % 10 = 0").select("tree", (F.col("ord") * 10 + 1).alias("line"))
    return outlines.missed(gold, matched, free, 1).drop("tree")


@query("""SELECT l_returnflag, count(*) FILTER (g IS NOT NULL) AS eligible, count(*) FILTER (g = p) AS correct, count(*) FILTER (g <> p AND NOT m) AS wrong, count(*) FILTER (g IS NOT NULL AND p IS NULL) AS missing, count(*) FILTER (g <> p AND m) AS source_disagreements,
    count(*) FILTER (g IS NOT NULL AND m) AS at_count_mismatch, count(*) FILTER (g IS NULL AND p IS NOT NULL) AS pred_only, round(count(*) FILTER (g = p) / CAST(count(*) FILTER (g IS NOT NULL) - count(*) FILTER (g <> p AND m) AS DOUBLE), 6) AS accuracy
    FROM (SELECT l_returnflag, CASE WHEN l_linenumber % 5 <> 0 THEN l_linenumber END AS g, CASE WHEN CAST(l_quantity AS BIGINT) % 7 <> 0 THEN l_linenumber + CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 0 END END AS p, l_partkey % 4 = 0 AS m FROM lineitem) GROUP BY l_returnflag""")
def child_count_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber")
    rows = load(spark, sf_dir, "lineitem").select("l_returnflag", F.when(k % 5 != 0, k).alias("gold_count"), F.when(F.col("l_quantity").cast("bigint") % 7 != 0, k + F.when(F.col("l_suppkey") % 3 == 0, 1).otherwise(0)).alias("pred_count"), (F.col("l_partkey") % 4 == 0).alias("mismatch"))
    return outlines.child_counts(rows, ["l_returnflag"])


@query("""WITH h AS (SELECT l_shipmode, k, count(*) AS n FROM (SELECT l_orderkey % 7 AS l_shipmode, l_linenumber - (l_linenumber + l_suppkey % 4 - 1) AS k FROM lineitem) GROUP BY ALL), m AS (SELECT l_shipmode, sum(n) AS pairs, first(k ORDER BY n DESC, abs(k), k) AS mode FROM h GROUP BY l_shipmode)
    SELECT h.l_shipmode AS part, CAST(any_value(pairs) AS BIGINT) AS pairs, any_value(mode) AS mode, round(sum(n) FILTER (k = mode) / any_value(pairs), 6) AS share_at_mode, round(sum(n) FILTER (abs(k - mode) <= 1) / any_value(pairs), 6) AS share_within_1 FROM h JOIN m USING (l_shipmode) GROUP BY h.l_shipmode""")
def depth_offset_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber")
    rows = load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 7).alias("part"), k.alias("pred_level"), (k + F.col("l_suppkey") % 4 - 1).alias("gold_level"))
    return outlines.depth_offsets(rows, ["part"])


@query("""SELECT l_returnflag, count(l_partkey) AS counted, count(DISTINCT l_partkey) AS distinct_lines, count(l_partkey) - count(DISTINCT l_partkey) AS over FROM lineitem GROUP BY l_returnflag""")
def key_line_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("l_partkey").alias("counted"), F.countDistinct("l_partkey").alias("distinct_lines"))
    return found.withColumn("over", F.col("counted") - F.col("distinct_lines"))


# ---- sequences of lines ----------------------------------------------------------------------------------------------


@query(f"""WITH {SPANS_SQL}, r AS (SELECT user_id, s, e FROM sp), c AS (SELECT user_id, s, e FROM sp WHERE event_id % 4 = 0), b AS (SELECT user_id, s AS pos FROM sp UNION SELECT user_id, e + 1 FROM sp), g AS (SELECT user_id, pos, lead(pos) OVER (PARTITION BY user_id ORDER BY pos) AS nxt FROM b),
    k AS (SELECT user_id, pos, nxt FROM g WHERE nxt IS NOT NULL AND EXISTS (SELECT 1 FROM r WHERE r.user_id = g.user_id AND r.s <= g.pos AND g.pos <= r.e) AND NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = g.user_id AND c.s <= g.pos AND g.pos <= c.e)),
    n AS (SELECT *, sum(CASE WHEN p IS DISTINCT FROM pos THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos) AS i FROM (SELECT *, lag(nxt) OVER (PARTITION BY user_id ORDER BY pos) AS p FROM k))
    SELECT user_id, min(pos) AS s, max(nxt) - 1 AS e FROM n GROUP BY user_id, i""")
def ranges_minus_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = event_spans(spark, sf_dir)
    return sequences.minus(spans, spans.where("event_id % 4 = 0"), ["user_id"], "s", "e")


@query(f"""WITH RECURSIVE {LINES_SQL}, cu AS (SELECT doc_id, line_no, n, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS upto FROM lo),
    g AS (SELECT doc_id, line_no, CAST(0 AS BIGINT) AS w, CAST(n AS BIGINT) AS size FROM cu WHERE line_no = 0 UNION ALL SELECT cu.doc_id, cu.line_no, g.w + CASE WHEN g.size > 0 AND g.size + cu.n > 400 THEN 1 ELSE 0 END, CASE WHEN g.size > 0 AND g.size + cu.n > 400 THEN cu.n ELSE g.size + cu.n END FROM g JOIN cu ON cu.doc_id = g.doc_id AND cu.line_no = g.line_no + 1),
    wd AS (SELECT g.doc_id, w, min(g.line_no) AS a, max(g.line_no) AS b, CAST(sum(n) AS BIGINT) AS chars, min(upto - n) AS before, max(upto) AS after FROM g JOIN cu USING (doc_id, line_no) GROUP BY g.doc_id, w)
    SELECT wd.doc_id, w AS "window", a AS first, b AS last, chars AS n_chars, least(a, min(line_no) FILTER (line_no < a AND before - (upto - n) <= 100)) AS shown_first, greatest(b, max(line_no) FILTER (line_no > b AND upto - after <= 100)) AS shown_last FROM wd JOIN cu USING (doc_id) GROUP BY wd.doc_id, w, a, b, chars, before, after""")
def windows_with_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of(spark, sf_dir).select("doc_id", "line_no", F.length("line").alias("n"))
    return sequences.line_windows(lines, ["doc_id"], "line_no", "n", 400)


@query(f"""WITH {CHAINED_SQL}, s AS (SELECT tree, k * 10 + q % 10 AS a, k * 10 + q % 10 + q AS b FROM ch) SELECT CAST(tree AS VARCHAR) AS tree, a AS start, CASE WHEN n IS NULL THEN 200 WHEN b = n THEN n ELSE greatest(n - 1, a) END AS until FROM (SELECT *, lead(a) OVER (PARTITION BY tree ORDER BY a) AS n FROM s)""")
def stitched_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ord") * 10 + F.col("q") % 10
    rows = chained(spark, sf_dir).select("tree", at.alias("start"), (at + F.col("q")).alias("end"))
    return sequences.stitched(rows, ["tree"], "start", "end", F.lit(200)).select("tree", "start", F.col("until").cast("bigint").alias("until"))


@query()
def chart_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as a chart: an item that announces two takes the next two marked ones."""
    items = chained(spark, sf_dir).select("tree", "ord", (F.col("q") % 5 != 0).alias("ordinal"), F.when(F.col("q") % 3 == 0, 2 + F.col("q") % 2).alias("count"))
    return sequences.chart_parents(items, ["tree"], "ord")


@query("""WITH l AS (SELECT o_orderkey, o_custkey, 1 + o_orderkey % 4 AS level FROM orders), m AS (SELECT o_custkey, max(o_orderkey) AS last FROM l GROUP BY 1)
    SELECT a.o_orderkey, coalesce(min(b.o_orderkey) - 1, any_value(m.last)) AS end_at FROM l a JOIN m USING (o_custkey) LEFT JOIN l b ON a.o_custkey = b.o_custkey AND b.o_orderkey > a.o_orderkey AND b.level <= a.level GROUP BY a.o_orderkey""")
def unit_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (1 + F.col("o_orderkey") % 4).alias("level"))
    last = rows.groupBy("o_custkey").agg(F.max("o_orderkey").alias("last"))
    return sequences.unit_ends(rows.join(last, "o_custkey"), ["o_custkey"], "o_orderkey", "level", F.col("last")).select("o_orderkey", "end_at")


@query(f"""WITH {LINES_SQL}, b AS (SELECT doc_id, line_no, trim(line) = '' AS bl, line_no % 7 = 0 AS bar FROM lo), x AS (SELECT *, sum(CASE WHEN lag IS NOT NULL AND bl AND NOT bar THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS u FROM (SELECT *, lag(bl) OVER (PARTITION BY doc_id ORDER BY line_no) AS lag FROM b)),
    y AS (SELECT doc_id, u, bool_and(bl) AS bl, arg_min(bar, line_no) AS bar FROM x GROUP BY doc_id, u), z AS (SELECT *, sum(CASE WHEN coalesce(p AND NOT bar, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY u) AS unit FROM (SELECT *, lag(bl) OVER (PARTITION BY doc_id ORDER BY u) AS p FROM y))
    SELECT doc_id, CAST(unit AS BIGINT) AS unit, min(line_no) AS first_line, count(*) AS n_lines FROM x JOIN z USING (doc_id, u) GROUP BY ALL""")
def blank_lines_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines_of(spark, sf_dir).select("doc_id", "line_no", "line")
    found = sequences.merged_blanks(rows, ["doc_id"], "line_no", F.trim("line") == "", F.col("line_no") % 7 == 0)
    return found.groupBy("doc_id", "unit").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"))
