"""Queries on markup, outlines, tree matching, families and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.search import common_lengths, find_staged
from ..operators import graph, match, outline, segment, tree
from ..sources import markup
from ..streaming import events as streams
from .relations import NODES_SQL, WALK_SQL, nodes_of
from .tables import load, spread
from .texts import LINES_SQL, PACK_SQL

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query(f"WITH {LINES_SQL} SELECT doc_id AS text_id, line_no, lpad(CAST(line_no AS VARCHAR), 6, '0') AS linehead, length(line) AS n, sha256(line) AS digest FROM lo")
def tei_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as TEI-like XML with a break before each line, and read back as line records."""
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.transform(F.split(escaped, "\n"), lambda x, i: F.concat(F.lit('<lb n="'), F.lpad(i.cast("string"), 6, "0"), F.lit('"/>'), x))
    xml = F.encode(F.concat(F.lit("<TEI><teiHeader><title>t</title></teiHeader><text>"), F.array_join(lines, ""), F.lit("</text></TEI>")), "UTF-8")
    files = spread(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(F.col("doc_id").cast("string").alias("text_id"), xml.alias("content"))
    found, _ = markup.read_lines(files)
    return found.select(F.col("text_id").cast("bigint").alias("text_id"), "line_no", "linehead", F.length("text").cast("bigint").alias("n"), F.sha2("text", 256).alias("digest"))


@query(r"""SELECT page_id, len(regexp_extract_all(html, '<a[ >]')) AS n_a, len(regexp_extract_all(html, '<li[ >]')) AS n_li, len(regexp_extract_all(html, '<p[ >]')) AS n_p FROM (SELECT page_id, regexp_replace(html, '<script>[^<]*(</p>[^<]*)*</script>', '', 'g') AS html FROM pages)""")
def html_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = F.col("event") == "open"
    found = markup.html_events(load(spark, sf_dir, "pages"))
    return found.groupBy("page_id").agg(*(F.count_if(opened & (F.col("name") == t)).alias(f"n_{t}") for t in ("a", "li", "p")))


@query("""SELECT date_trunc('hour', ts) AS "start", date_trunc('hour', ts) + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.windowed(load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return found.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz"), "total": F.round("total", 4)})


@query("""WITH g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))
    SELECT min(ts) AS "start", max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n FROM g GROUP BY user_id, s""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.sessions(load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return found.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query("""SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id""")
def last_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.last_of_key(load(spark, sf_dir, "events"), "user_id", "event_id", "value")


@query("""WITH RECURSIVE l AS (SELECT 'c' || c_custkey AS a, 'k' || c_nationkey || c_mktsegment AS b FROM customer), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a AS id, a AS seen FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen) SELECT id, min(seen) AS family FROM r GROUP BY id""")
def connected_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that share a nation and segment, and those keys."""
    links = load(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("a"), F.concat(F.lit("k"), F.col("c_nationkey").cast("string"), "c_mktsegment").alias("b"))
    return graph.families(links, "a", "b")


@query(f"""WITH {NODES_SQL.strip().rstrip(',')}, d AS (SELECT *, left(id, 1) = 's' AND ord % 5 = 0 AS dropped, left(id, 1) = 's' AND ord % 5 = 1 AS moved FROM nodes)
    SELECT 'geo' AS tree, count(*) FILTER (NOT dropped AND NOT moved) AS tp, count(*) FILTER (NOT dropped AND moved) AS fp, count(*) FILTER (dropped OR moved) AS fn,
    round(count(*) FILTER (NOT dropped AND NOT moved) / CAST(count(*) FILTER (NOT dropped) AS DOUBLE), 6) AS p, round(count(*) FILTER (NOT dropped AND NOT moved) / CAST(count(*) AS DOUBLE), 6) AS r,
    round(2 * count(*) FILTER (NOT dropped AND NOT moved) / CAST(count(*) + count(*) FILTER (NOT dropped) AS DOUBLE), 6) AS f FROM d""")
def tree_match_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of regions, nations, suppliers and customers against a copy without every fifth supplier and with another fifth
    out of reach.

    The outcome is known: what is dropped or moved is missed, what is moved is wrong, all else matches.
    """
    nodes = nodes_of(spark, sf_dir)
    leaf, line = F.substring("id", 1, 1) == "s", F.col("ord") * 10
    gold = nodes.select("tree", "id", "parent", line.alias("line"), F.col("ord").alias("order"))
    moved = F.when(leaf & (F.col("ord") % 5 == 1), line + 1_000_000_000).otherwise(line)
    pred = nodes.where(~(leaf & (F.col("ord") % 5 == 0))).select("tree", "id", "parent", moved.alias("line"), F.col("ord").alias("order"))
    return match.tree_scores(pred, gold)


@query()
def order_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer: how many orders are in the longest chain of prices that never fall."""
    rows = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return match.kept_in_order(rows, ["o_custkey"], "o_orderkey", "o_totalprice").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if("in_chain").alias("n_chain"))


OUTLINE_SQL = """nd AS (SELECT doc_id AS tree, doc_id || '-' || k AS id, CASE WHEN k > 0 THEN doc_id || '-' || (k // 2 * 2) % (k + 1 - k % 2) END AS parent, k AS "order",
    CASE WHEN k % 4 = 3 THEN (length(text) * k) // 10 ELSE (length(text) * k) // 8 END AS pos, length(text) AS total FROM documents, range(0, 8) t(k) WHERE text <> '')"""


def outline_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight nodes a document at known shares of its length, every fourth of them out of order."""
    docs = load(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.length("text").cast("bigint").alias("total"), F.explode(F.sequence(F.lit(0), F.lit(7)).cast("array<bigint>")).alias("order"))
    at = F.when(F.col("order") % 4 == 3, F.floor(F.col("total") * F.col("order") / 10)).otherwise(F.floor(F.col("total") * F.col("order") / 8))
    name = F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.col("order").cast("string"))
    return docs.select(F.col("doc_id").cast("string").alias("tree"), name.alias("id"), F.lit(None).cast("string").alias("parent"), "order", at.alias("at"), "total")


FLAT_SQL = OUTLINE_SQL.replace("CASE WHEN k > 0 THEN doc_id || '-' || (k // 2 * 2) % (k + 1 - k % 2) END", "NULL")
SPANS_OF_SQL = f"""{FLAT_SQL}, b AS (SELECT *, max(pos) OVER (PARTITION BY tree ORDER BY "order" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bar FROM nd),
    pl AS (SELECT *, coalesce(lead(pos) OVER (PARTITION BY tree ORDER BY "order"), total) AS e FROM b WHERE pos >= coalesce(bar, 0)),
    os AS (SELECT CAST(tree AS VARCHAR) AS tree, id AS node, 'leaf' AS kind, pos AS char_start, e AS char_end_excl FROM pl WHERE e > pos)"""


@query(f"WITH {SPANS_OF_SQL} SELECT * FROM os")
def outlined_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = outline_nodes(spark, sf_dir)
    return outline.outlined(nodes.drop("total"), nodes.select("tree", "total").distinct())


@query(f"""WITH {SPANS_OF_SQL}, t AS (SELECT CAST(doc_id AS VARCHAR) AS tree, length(text) AS total FROM documents WHERE text <> ''), c AS (SELECT tree, CAST(sum(char_end_excl - char_start) AS BIGINT) AS covered FROM os GROUP BY tree)
    SELECT tree, coalesce(covered, 0) AS covered, round(coalesce(covered, 0) / CAST(total AS DOUBLE), 6) AS ratio, CAST(0 AS BIGINT) AS n_overlaps FROM t LEFT JOIN c USING (tree)""")
def outline_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = outline_nodes(spark, sf_dir)
    totals = nodes.select("tree", "total").distinct()
    return outline.coverage(outline.outlined(nodes.drop("total"), totals), totals)


@query(PACK_SQL.rstrip() + f""", {SPANS_OF_SQL} SELECT os.tree, os.node, max(c.chunk_no) AS chunk_no FROM os LEFT JOIN c ON CAST(c.doc_id AS VARCHAR) = os.tree AND c.char_start <= os.char_start GROUP BY ALL""")
def chunk_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = outline_nodes(spark, sf_dir)
    spans = outline.outlined(nodes.drop("total"), nodes.select("tree", "total").distinct())
    chunks = segment.chunked(load(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("tree", F.col("doc_id").cast("string"))
    return outline.markers(spans, chunks)


CHECKED_SQL = """n AS (SELECT l_orderkey AS tree, l_orderkey || '-' || row_number() OVER w AS id, CASE WHEN row_number() OVER w > 1 THEN l_orderkey || '-1' END AS parent, CASE WHEN row_number() OVER w > 1 THEN 2 ELSE 1 END AS level,
    row_number() OVER w AS "order", CAST(l_quantity AS BIGINT) AS s, CAST(l_quantity AS BIGINT) + l_suppkey % 20 - 2 AS e, CASE WHEN row_number() OVER w = 1 THEN 3 END AS announced FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate))"""


def checked_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as children of its first line, with spans of known faults."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    rows = load(spark, sf_dir, "lineitem").withColumn("order", F.row_number().over(w).cast("bigint"))
    tree_, first, start = F.col("l_orderkey").cast("string"), F.col("order") == 1, F.col("l_quantity").cast("bigint")
    return rows.select(tree_.alias("tree"), F.concat(tree_, F.lit("-"), F.col("order").cast("string")).alias("id"), F.when(~first, F.concat(tree_, F.lit("-1"))).alias("parent"), F.when(first, 1).otherwise(2).alias("level"), "order", start.alias("start"), (start + F.col("l_suppkey") % 20 - 2).alias("end"), F.when(first, 3).alias("announced"))


@query(f"""WITH {CHECKED_SQL}, j AS (SELECT n.*, p.s AS ps, p.e AS pe, (SELECT count(*) FROM n k WHERE k.parent = n.id) AS kids, max(n.s) OVER (PARTITION BY n.tree, n.parent ORDER BY n."order" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM n LEFT JOIN n p ON p.id = n.parent)
    SELECT CAST(tree AS VARCHAR) AS tree, id, 'error' AS severity, 'span-backward' AS code, CAST(e AS VARCHAR) AS detail FROM j WHERE e < s
    UNION ALL SELECT CAST(tree AS VARCHAR), id, 'error', 'outside-parent', CAST(s AS VARCHAR) FROM j WHERE s < ps OR e > pe
    UNION ALL SELECT CAST(tree AS VARCHAR), id, 'error', 'sibling-order', CAST(before AS VARCHAR) FROM j WHERE s < before
    UNION ALL SELECT CAST(tree AS VARCHAR), id, 'warning', 'count-mismatch', CAST(kids AS VARCHAR) FROM j WHERE announced <> kids""")
def structural_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.findings(checked_nodes(spark, sf_dir))


@query()
def repair_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.repaired(checked_nodes(spark, sf_dir).select("tree", "id", "parent", "order", "start", "end"))


@query(f"""WITH {CHECKED_SQL} SELECT reason, count(*) AS n FROM (SELECT CASE WHEN s % 7 = 0 THEN 'no_key' WHEN level = 1 THEN 'out_of_split' WHEN s > 40 THEN 'out_of_scoring_scope' WHEN e > 50 THEN 'out_of_coverage' ELSE 'counted' END AS reason FROM n) GROUP BY reason""")
def eligibility_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checked_nodes(spark, sf_dir).withColumns({"line": F.when(F.col("start") % 7 != 0, F.col("start")), "split": F.when(F.col("level") == 1, "test").otherwise("dev")})
    return outline.eligibility(rows, "dev", F.col("start") <= 40, F.col("end") <= 50).groupBy("reason").agg(F.count("*").alias("n"))


@query(WALK_SQL + 'SELECT num.id, nodes.heading, level, "order" FROM num JOIN nodes USING (id)')
def markdown_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes as they come back from the rendered outline."""
    nodes = tree.numbered(nodes_of(spark, sf_dir)).join(nodes_of(spark, sf_dir).select("id", "heading"), "id")
    return outline.parse_markdown(outline.markdown(nodes)).select("id", "heading", "level", "order")


@query(WALK_SQL + ", s2 AS (SELECT id, level, size FROM siz) SELECT level, count(*) AS n, CAST(sum(size) AS BIGINT) AS nodes_below, count(*) FILTER (size = 1) AS leaves, max(size) AS largest FROM s2 GROUP BY level")
def outline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tree.subtree_sizes(tree.numbered(nodes_of(spark, sf_dir)))
    return sizes.groupBy("level").agg(F.count("*").alias("n"), F.sum("size").alias("nodes_below"), F.count_if(F.col("size") == 1).alias("leaves"), F.max("size").alias("largest"))


@query()
def staged_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the end of each benchmark item with a blank dropped is found in the item: whole, gapped, suffix or prefix."""
    items = load(spark, sf_dir, "benchmark").select("item_id", "text", F.concat(F.substring("text", 11, 8), F.substring("text", 21, 6)).alias("needle"))
    found = items.select("item_id", find_staged("text", "needle").alias("x"), common_lengths("text", "needle").alias("c"))
    return found.select("item_id", "x.method", "x.start", "x.end_excl", "c.substring", "c.subsequence")
