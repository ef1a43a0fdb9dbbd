"""Queries on pieces and regions, placements and fallbacks, votes, caches, roll-ups, and identifiers made from content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import search
from ..functions import text as T
from ..operators import intervals, segment, tree
from .records import first_of
from .relations import ASSIGNED_SQL, NODES_SQL, SPANS_SQL, WALK_SQL, assigned, event_spans, nodes_of
from .tables import load
from .texts import LINES_SQL, PIECES_SQL, lines_of

QUERIES, ORACLE_SQL = {}, {}
PLAIN_NODES = NODES_SQL.strip().rstrip(",")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# ---- pieces and regions ----------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, i - 1 AS piece_no, x AS piece, s AS char_start FROM (SELECT p_partkey, unnest([1, 2, 3]) AS i, unnest([p_name || '　　', p_type || '　', p_brand]) AS x, unnest([0, length(p_name) + 2, length(p_name) + 3 + length(p_type)]) AS s FROM part)""")
def verse_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verse cut after each run of wide blanks, with offsets."""
    text = F.concat("p_name", F.lit("　　"), "p_type", F.lit("　"), "p_brand")
    rows = load(spark, sf_dir, "part").select("p_partkey", segment.sentence_pieces(text, "　", "　").alias("p"))
    placed = rows.withColumn("s", segment.starts_of(F.transform("p", lambda x: F.length(x).cast("bigint"))))
    return placed.select("p_partkey", F.posexplode(F.arrays_zip("p", "s")).alias("piece_no", "x")).select("p_partkey", F.col("piece_no").cast("bigint").alias("piece_no"), F.col("x.p").alias("piece"), F.col("x.s").alias("char_start"))


REGIONS_SQL = f"""{LINES_SQL}, hl AS (SELECT doc_id, char_start AS s, char_start + n + 1 AS e FROM lo WHERE line_no % 3 <> 1), h1 AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hl),
    h2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM h1), rg AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM h2 GROUP BY doc_id, g)"""


@query(f"""WITH {PIECES_SQL}, {REGIONS_SQL} SELECT o.doc_id, count(*) AS n, count(rg.s) AS n_inside FROM o LEFT JOIN rg ON rg.doc_id = o.doc_id AND rg.s <= o.char_end_excl - o.n AND o.char_end_excl - o.n < rg.e GROUP BY o.doc_id""")
def sentences_in_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sentences begin in a heading region; regions are runs of marked lines made one, and disjoint, so the last that begins
    before a place is the only one that can hold it."""
    lines = lines_of(spark, sf_dir).where("line_no % 3 <> 1").select("doc_id", F.col("char_start").alias("s"), (F.col("char_start") + F.length("line") + 1).alias("e"))
    regions = intervals.merged(lines, ["doc_id"], "s", "e").select("doc_id", "s", "e")
    sentences = segment.sentences(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "sent_no", "char_start")
    found = intervals.as_of(sentences, regions, ["doc_id"], "char_start", "s", ["s", "e"])
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("char_start") < F.col("e")).alias("n_inside"))


@query(f"""WITH {PIECES_SQL} SELECT doc_id, count(*) AS n, count(*) FILTER (trim(sentence) = '') AS n_blank, CAST(sum(n) AS BIGINT) = max(char_end_excl) AS contiguous, count(*) FILTER (contains(sentence, chr(10)) AND NOT ends_with(trim(sentence, ' ' || chr(9) || chr(13)), chr(10))) AS n_crossing FROM o GROUP BY doc_id""")
def sentence_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per text: sentences, blank ones, whether they follow one another without gaps, and those with a line's end inside."""
    rows = segment.sentences(load(spark, sf_dir, "documents").select("doc_id", "text"))
    inner = F.contains("sentence", F.lit("\n")) & ~F.endswith(F.regexp_replace("sentence", "^[ \\t\\r]+|[ \\t\\r]+$", ""), F.lit("\n"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.trim("sentence") == "").alias("n_blank"), (F.sum(F.length("sentence")) == F.max("char_end_excl")).alias("contiguous"), F.count_if(inner).alias("n_crossing"))


@query(f"""WITH {PIECES_SQL}, {LINES_SQL}, sp AS (SELECT doc_id, sent_no, char_end_excl - n AS s, char_end_excl AS e FROM o) SELECT sp.doc_id, sent_no, count(*) AS n_segments FROM sp JOIN lo ON lo.doc_id = sp.doc_id AND sp.s < lo.char_start + lo.n AND lo.char_start < sp.e GROUP BY ALL HAVING count(*) > 1""")
def sentences_over_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences dealt to segments, here lines: those that lie in more than one, with how many."""
    sentences = segment.sentences(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "sent_no", F.col("char_start").alias("s"), F.col("char_end_excl").alias("e"))
    lines = lines_of(spark, sf_dir).select("doc_id", F.col("char_start").alias("a"), (F.col("char_start") + F.length("line")).alias("b"))
    found = intervals.overlapping(sentences, lines, ["doc_id"], "s", "e", "a", "b")
    return found.groupBy("doc_id", "sent_no").agg(F.count("*").alias("n_segments")).where("n_segments > 1")


@query(f"""WITH RECURSIVE {LINES_SQL}, u AS (SELECT doc_id, line_no // 8 AS unit, line_no % 8 AS k, n FROM lo), g AS (SELECT doc_id, unit, k, CAST(0 AS BIGINT) AS w, CAST(1 AS BIGINT) AS m, CAST(n AS BIGINT) AS c FROM u WHERE k = 0
    UNION ALL SELECT u.doc_id, u.unit, u.k, g.w + CASE WHEN g.m + 1 <= 3 AND g.c + u.n <= 200 THEN 0 ELSE 1 END, CASE WHEN g.m + 1 <= 3 AND g.c + u.n <= 200 THEN g.m + 1 ELSE 1 END, CASE WHEN g.m + 1 <= 3 AND g.c + u.n <= 200 THEN g.c + u.n ELSE u.n END FROM g JOIN u ON u.doc_id = g.doc_id AND u.unit = g.unit AND u.k = g.k + 1)
    SELECT doc_id, unit, max(w) + 1 AS n_chunks, count(*) AS n_lines FROM g GROUP BY doc_id, unit""")
def packed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of eight lines packed into chunks of at most three lines and 200 characters, never across units."""
    lines = lines_of(spark, sf_dir).select("doc_id", F.floor(F.col("line_no") / 8).alias("unit"), "line_no", F.length("line").cast("bigint").alias("n"))
    units = lines.groupBy("doc_id", "unit").agg(F.array_sort(F.collect_list(F.struct("line_no", "n"))).alias("l"))
    sizes = F.transform("l", lambda x: x["n"])
    return units.select("doc_id", "unit", segment.window_count(sizes, F.lit(3), 200).cast("bigint").alias("n_chunks"), F.size("l").cast("bigint").alias("n_lines"))


@query(f"""WITH RECURSIVE {SPANS_SQL}, z AS (SELECT user_id, event_id, s, e, row_number() OVER (PARTITION BY user_id ORDER BY s, -e, event_id) AS k FROM sp), w AS (SELECT user_id, event_id, k, e AS until, true AS kept FROM z WHERE k = 1
    UNION ALL SELECT z.user_id, z.event_id, z.k, CASE WHEN z.s >= w.until THEN z.e ELSE w.until END, z.s >= w.until FROM w JOIN z ON z.user_id = w.user_id AND z.k = w.k + 1) SELECT user_id, event_id FROM w WHERE kept""")
def suppressed_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches that stay when the first, and of those at one place the longest, suppresses what it overlaps: a fold over the
    matches of one text."""
    spans = event_spans(spark, sf_dir)
    item = F.struct("s", (-F.col("e")).alias("minus"), "event_id")
    folded = spans.groupBy("user_id").agg(F.array_sort(F.collect_list(item)).alias("l"))
    step = lambda until, x: F.struct(F.when(x["s"] >= until, -x["minus"]).otherwise(until).alias("state"), (x["s"] >= until).alias("out"))
    kept = folded.withColumn("k", segment.folded(F.col("l"), F.lit(-(2**62)).cast("bigint"), step, "boolean"))
    return kept.select("user_id", F.explode(F.arrays_zip("l", "k")).alias("x")).where("x.k").select("user_id", "x.l.event_id")


@query(f"""WITH {LINES_SQL} SELECT doc_id, line_no, coalesce(CASE WHEN line_no % 4 = 0 THEN line_no // 3 END, CASE WHEN line_no % 4 = 1 THEN (line_no - 1) // 3 END, CASE WHEN line_no % 4 = 2 THEN 0 END) AS after_chunk, CASE line_no % 4 WHEN 0 THEN 'own' WHEN 1 THEN 'parent' WHEN 2 THEN 'first' ELSE 'unplaced' END AS how FROM lo""")
def announcement_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After which chunk an announcement stands: that of its own line, else its parent's, else the first; or nowhere."""
    k = F.col("line_no") % 4
    own, parent, first = F.when(k == 0, F.floor(F.col("line_no") / 3)), F.when(k == 1, F.floor((F.col("line_no") - 1) / 3)), F.when(k == 2, 0)
    how = first_of([(own.isNotNull(), "own"), (parent.isNotNull(), "parent"), (first.isNotNull(), "first")], "unplaced")
    return lines_of(spark, sf_dir).select("doc_id", "line_no", F.coalesce(own, parent, first).alias("after_chunk"), how.alias("how"))


@query(r"""SELECT doc_id, i - 1 AS mark_no, m[i] AS mark FROM (SELECT doc_id, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+') AS m FROM documents))""")
def marks_with_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+)"), 1)).alias("mark_no", "mark"))
    return rows.withColumn("mark_no", F.col("mark_no").cast("bigint"))


@query("""SELECT p_partkey, unnest(CASE WHEN p_size % 3 = 0 THEN ['enter', 'announce'] ELSE ['announce'] END) AS kind, unnest(CASE WHEN p_size % 3 = 0 THEN [p_brand, p_name] ELSE [p_name] END) AS subject, unnest(CASE WHEN p_size % 3 = 0 THEN ['enter', 'announce-' || p_size] ELSE ['announce-' || p_size] END) AS slug FROM part""")
def split_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subject that opens with a marker is two statements; each gets the slug of its rule."""
    opens = F.col("p_size") % 3 == 0
    one = lambda kind, subject: F.struct(F.lit(kind).alias("kind"), F.col(subject).alias("subject"))
    made = F.when(opens, F.array(one("enter", "p_brand"), one("announce", "p_name"))).otherwise(F.array(one("announce", "p_name")))
    rows = load(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(made).alias("x")).select("p_partkey", "p_size", "x.*")
    return rows.select("p_partkey", "kind", "subject", F.when(F.col("kind") == "enter", "enter").otherwise(F.concat(F.lit("announce-"), F.col("p_size").cast("string"))).alias("slug"))


# ---- likeness and votes ----------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'verbatim' WHEN 1 THEN 'partial' ELSE 'absent' END AS class, CASE c_custkey % 3 WHEN 1 THEN round(m / CAST(m + 3 AS DOUBLE), 6) WHEN 2 THEN round(m / CAST(m + 2 * m AS DOUBLE), 6) END AS ratio
    FROM (SELECT c_custkey, length(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) AS m FROM customer)""")
def text_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text stands in another verbatim, in order for six tenths, or not, punctuation left out."""
    k = F.col("c_custkey") % 3
    hay = T.strip_punct(F.col("c_name"))
    needle = F.when(k == 0, hay).when(k == 1, F.concat(F.lit("ÿÿ"), hay, F.lit("ÿ"))).otherwise(F.concat(F.repeat(F.lit("ÿ"), F.length(hay)), hay, F.repeat(F.lit("ÿ"), F.length(hay))))
    rows = load(spark, sf_dir, "customer").select("c_custkey", hay.alias("h"), needle.alias("n")).withColumn("c", search.common_lengths("n", "h"))
    ratio = F.when(~F.contains("h", "n"), F.round(F.col("c.subsequence") / F.length("n"), 6))
    return rows.select("c_custkey", F.when(ratio.isNull(), "verbatim").when(ratio >= 0.6, "partial").otherwise("absent").alias("class"), ratio.alias("ratio"))


@query("""WITH n AS (SELECT DISTINCT p_name AS x, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_type AS t FROM part), l AS (SELECT x, t, unnest(string_split(t, ' ')) AS label FROM n),
    s AS (SELECT x, t, label, CAST(len(list_filter(list_distinct(string_split(lower(label), '')), lambda c: contains(x, c))) AS DOUBLE) / len(list_distinct(string_split(lower(label), ''))) AS sim FROM l) SELECT x, t, arg_max(label, sim * 1000 - length(label)) AS best FROM s GROUP BY x, t""")
def best_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the labels of an item the one most like its name: by shared characters, then the shorter."""
    rows = load(spark, sf_dir, "part").select(F.col("p_name").alias("x"), F.col("p_type").alias("t")).distinct()
    labels = rows.select("x", "t", F.explode(F.split("t", " ")).alias("label"))
    kinds = F.array_distinct(T.characters(F.lower("label")))
    share = F.size(F.array_intersect(T.characters(F.col("x")), kinds)) / F.size(kinds)
    return labels.groupBy("x", "t").agg(F.max_by("label", share * 1000 - F.length("label")).alias("best"))


@query("""SELECT l_orderkey, arg_max(l_partkey, votes * 10000000 - l_partkey) AS target, max(votes) AS votes FROM (SELECT l_orderkey, l_partkey, len(list_intersect(list_distinct(string_split(p_name, '')), list_distinct(string_split(p_type, '')))) AS votes FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY l_orderkey""")
def overlap_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item with the most characters in common, of equal ones the first."""
    items = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.size(F.array_intersect(T.characters(F.col("p_name")), T.characters(F.col("p_type")))).alias("votes"))
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(items, "l_partkey")
    return rows.groupBy("l_orderkey").agg(F.max_by("l_partkey", F.struct(F.col("votes"), -F.col("l_partkey"))).alias("target"), F.max("votes").cast("bigint").alias("votes"))


@query("""SELECT conv_id, turn, upto FROM (SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS upto FROM conversations) WHERE upto <= 250""")
def heads_under_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum(F.length("text")).over(w).alias("upto")).where("upto <= 250")


# ---- trees -----------------------------------------------------------------------------------------------------------


@query(WALK_SQL + """SELECT a.id, CASE WHEN a.id = 'n3' THEN 'focus' WHEN starts_with(f.path, a.path || '.') THEN 'ancestor' ELSE 'sibling' END AS role FROM num a, (SELECT * FROM num WHERE id = 'n3') f WHERE a.id = 'n3' OR a.parent = f.parent OR starts_with(f.path, a.path || '.')""")
def outline_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node with its ancestors and siblings, each with its part in the context; the focus is one row."""
    rows = tree.numbered(nodes_of(spark, sf_dir))
    focus = F.broadcast(rows.where("id = 'n3'").select("tree", F.col("path").alias("f_path"), F.col("parent").alias("f_parent")))
    both = rows.join(focus, "tree")
    above = F.startswith("f_path", F.concat("path", F.lit(".")))
    role = F.when(F.col("path") == F.col("f_path"), "focus").when(above, "ancestor").when(F.col("parent") == F.col("f_parent"), "sibling")
    return both.select("id", role.alias("role")).where("role IS NOT NULL")


@query(WALK_SQL + """SELECT a.id, count(*) FILTER (left(b.id, 1) = 'n') AS folders, count(*) FILTER (left(b.id, 1) IN ('s', 'c')) AS works, max(b.level) - a.level AS depth FROM num a JOIN num b ON starts_with(b.path, a.path || '.') WHERE left(a.id, 1) IN ('r', 'n') GROUP BY a.id, a.level""")
def catalogue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders and works below each folder: a node is counted at each of its ancestors, by their paths."""
    rows = tree.numbered(nodes_of(spark, sf_dir))
    kind = F.substring("id", 1, 1)
    cut = F.expr("transform(sequence(1, size(split(path, '[.]')) - 1), k -> array_join(slice(split(path, '[.]'), 1, k), '.'))")
    below = rows.where("level > 1").select("tree", kind.alias("kind"), "level", F.explode(cut).alias("path"))
    sums = below.groupBy("tree", "path").agg(F.count_if(F.col("kind") == "n").alias("folders"), F.count_if(F.col("kind").isin("s", "c")).alias("works"), F.max("level").alias("deepest"))
    return rows.join(sums, ["tree", "path"]).select("id", "folders", "works", (F.col("deepest") - F.col("level")).alias("depth"))


@query(WALK_SQL + """SELECT left(path, 8) AS section, level, count(*) AS n FROM num GROUP BY ALL""")
def depth_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.numbered(nodes_of(spark, sf_dir)).groupBy(F.substring("path", 1, 8).alias("section"), "level").agg(F.count("*").alias("n"))


@query(WALK_SQL + """, k AS (SELECT num.*, row_number() OVER (PARTITION BY num.parent, left(nodes.heading, 6) ORDER BY "order") AS occ, left(nodes.heading, 6) AS h FROM num JOIN nodes USING (id) WHERE num.level = 3)
    SELECT a.id AS pred_id, b.id AS gold_id FROM k a JOIN k b ON a.parent = b.parent AND a.h = b.h AND a.occ = b.occ + 1""")
def greedy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of equal headings under one parent paired in order: the k-th on one side, here without its first, with the k-th on the other."""
    nodes = nodes_of(spark, sf_dir)
    rows = tree.numbered(nodes).join(nodes.select("id", F.substring("heading", 1, 6).alias("h")), "id").where("level = 3")
    occ = F.row_number().over(Window.partitionBy("parent", "h").orderBy("order"))
    gold = rows.select("parent", "h", occ.alias("occ"), F.col("id").alias("gold_id"))
    pred = gold.where("occ > 1").select("parent", "h", (F.col("occ") - 1).alias("occ"), F.col("gold_id").alias("pred_id"))
    return pred.join(gold, ["parent", "h", "occ"]).select("pred_id", "gold_id")


@query(f"""WITH RECURSIVE {PLAIN_NODES}, w AS (SELECT id, 1 AS level, id AS last, CAST(NULL AS VARCHAR) AS above, true AS kept FROM nodes WHERE parent IS NULL
    UNION ALL SELECT n.id, w.level + 1, CASE WHEN w.level + 1 <= 1 OR n.ord % 100 BETWEEN 10 AND 40 THEN n.id ELSE w.last END, w.last, w.level + 1 <= 1 OR n.ord % 100 BETWEEN 10 AND 40 FROM nodes n JOIN w ON n.parent = w.id) SELECT id, above AS parent FROM w WHERE kept""")
def oracle_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gold tree cut to its first level and the nodes of a span, each under the nearest that is left."""
    from ..operators import outlines

    keep = F.col("parent").isNull() | (F.col("ord") % 100).between(10, 40)
    return outlines.scored_parents(nodes_of(spark, sf_dir), F.when(keep, F.col("ord"))).drop("tree")


# ---- caches, roll-ups, dispatch --------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT c_custkey, sha256(c_name || '|' || c_nationkey || '|' || c_custkey % 50) AS h FROM customer), c AS (SELECT DISTINCT sha256(c_name || '|' || c_nationkey || '|' || c_custkey % 25) AS h FROM customer) SELECT CASE WHEN c.h IS NULL THEN 'miss' ELSE 'hit' END AS state, count(*) AS n FROM r LEFT JOIN c USING (h) GROUP BY 1""")
def row_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose inputs have been scored before, by a hash of all of them."""
    rows = load(spark, sf_dir, "customer")
    hash_of = lambda k: F.sha2(F.concat_ws("|", "c_name", "c_nationkey", F.col("c_custkey") % k), 256).alias("h")
    cached = rows.select(hash_of(25)).distinct().withColumn("state", F.lit("hit"))
    return rows.select(hash_of(50)).join(cached, "h", "left").groupBy(F.coalesce("state", F.lit("miss")).alias("state")).agg(F.count("*").alias("n"))


@query("""SELECT user_id, count(*) AS n_events, count(*) FILTER (event_type = 'purchase') AS n_bought, count(*) FILTER (value > 50) AS n_large, count(DISTINCT event_type) AS n_kinds, bool_or(value < 0) AS any_negative FROM events GROUP BY user_id""")
def audit_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n_events"), F.count_if(F.col("event_type") == "purchase").alias("n_bought"), F.count_if(F.col("value") > 50).alias("n_large"), F.countDistinct("event_type").alias("n_kinds"), F.bool_or(F.col("value") < 0).alias("any_negative"))


@query(f"WITH {ASSIGNED_SQL} SELECT split, count(*) AS n_lines, count(DISTINCT o_custkey) AS n_requests, min(pos) AS first_pos, max(pos) AS last_pos FROM asg GROUP BY split")
def lines_per_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n_lines"), F.countDistinct("o_custkey").alias("n_requests"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query("""SELECT p_type, CASE WHEN starts_with(p_type, 'S') THEN CAST(sum(p_size) AS DOUBLE) WHEN starts_with(p_type, 'P') THEN CAST(count(DISTINCT p_brand) AS DOUBLE) ELSE CAST(count(*) AS DOUBLE) END AS measure FROM part GROUP BY p_type""")
def format_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of dataset is counted by its own rule, all in one pass."""
    sums = load(spark, sf_dir, "part").groupBy("p_type").agg(F.sum("p_size").alias("s"), F.countDistinct("p_brand").alias("b"), F.count("*").alias("n"))
    rule = F.when(F.startswith("p_type", F.lit("S")), F.col("s")).when(F.startswith("p_type", F.lit("P")), F.col("b")).otherwise(F.col("n"))
    return sums.select("p_type", rule.cast("double").alias("measure"))


@query("""SELECT *, round(n / CAST(sum(n) OVER (PARTITION BY o_orderstatus) AS DOUBLE), 6) AS share FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)""")
def origin_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = load(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("o_orderstatus")), 6))


@query("""SELECT c_custkey, regexp_extract(lbl, '^part ([0-9]+)', 1) AS part, r_name AS collection FROM (SELECT c_custkey, 'part ' || c_nationkey % 7 || ' of ' || c_mktsegment AS lbl FROM customer) LEFT JOIN region ON CAST(r_regionkey AS VARCHAR) = regexp_extract(lbl, '^part ([0-9]+)', 1)""")
def collection_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.lit("part "), (F.col("c_nationkey") % 7).cast("string"), F.lit(" of "), "c_mktsegment")
    rows = load(spark, sf_dir, "customer").select("c_custkey", F.regexp_extract(label, "^part ([0-9]+)", 1).alias("part"))
    names = load(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("part"), F.col("r_name").alias("collection"))
    return rows.join(names, "part", "left").select("c_custkey", "part", "collection")


@query("""WITH d AS (SELECT n_nationkey AS k, n_nationkey AS a, (n_nationkey * 7) % 30 AS b FROM nation) SELECT d.k, x.n_name AS from_name, y.n_name AS to_name, CASE WHEN y.n_nationkey IS NULL THEN 'unknown' WHEN x.n_nationkey > y.n_nationkey THEN 'backward-range' ELSE 'range' END AS state FROM d LEFT JOIN nation x ON x.n_nationkey = d.a LEFT JOIN nation y ON y.n_nationkey = d.b""")
def resolved_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared ranges by the chapters that their ends name; an end that names none, and one before the start, are reported."""
    names = load(spark, sf_dir, "nation")
    ends = lambda p: names.select(F.col("n_nationkey").alias(p), F.col("n_name").alias(f"{p}_name"))
    declared = names.select(F.col("n_nationkey").alias("k"), F.col("n_nationkey").alias("from"), (F.col("n_nationkey") * 7 % 30).alias("to"))
    both = declared.join(ends("from"), "from", "left").join(ends("to"), "to", "left")
    return both.select("k", "from_name", "to_name", F.when(F.col("to_name").isNull(), "unknown").when(F.col("from") > F.col("to"), "backward-range").otherwise("range").alias("state"))


@query("""SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN nullif(trim(' ' || s_name || ' '), '') END, CASE WHEN s_suppkey % 3 = 1 THEN 'supplier ' || s_suppkey END, '(none)') AS heading, CASE WHEN s_suppkey % 5 = 0 THEN 'own' WHEN s_suppkey % 5 = 1 THEN 'link' WHEN s_suppkey % 2 = 0 THEN 'inherited' ELSE 'unlocated' END AS start_rule FROM supplier""")
def headings_and_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node's heading, from its title or from the tree, and the rule that gives its start."""
    k = F.col("s_suppkey")
    heading = F.coalesce(F.when(k % 3 == 0, F.nullif(F.trim(F.concat(F.lit(" "), "s_name", F.lit(" "))), F.lit(""))), F.when(k % 3 == 1, F.concat(F.lit("supplier "), k.cast("string"))), F.lit("(none)"))
    return load(spark, sf_dir, "supplier").select("s_suppkey", heading.alias("heading"), first_of([(k % 5 == 0, "own"), (k % 5 == 1, "link"), (k % 2 == 0, "inherited")], "unlocated").alias("start_rule"))


# ---- identifiers and text blocks -------------------------------------------------------------------------------------

#: Fixed value: the namespace of URLs in RFC 4122.
URLS = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = URLS) -> Column:
    """The name's version 5 UUID: the first half of a hash, with the version's and the variant's bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


@query("""SELECT r_regionkey, length(u) AS n, substring(u, 15, 1) AS version, substring(u, 20, 1) IN ('8', '9', 'a', 'b') AS variant FROM (SELECT r_regionkey, '12345678-1234-5234-8234-123456789012' AS u FROM region)""")
def minted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids minted from names: their form (their values are tested against the standard library)."""
    u = uuid5(F.concat(F.lit("https://example.org/"), "r_name"))
    return load(spark, sf_dir, "region").select("r_regionkey", F.length(u).cast("bigint").alias("n"), F.substring(u, 15, 1).alias("version"), F.substring(u, 20, 1).isin("8", "9", "a", "b").alias("variant"))


@query("""SELECT n_nationkey, 'before <!-- BEGIN t --> ' || n_name || ' <!-- END t --> after <!-- BEGIN u --> kept <!-- END u -->' AS guide FROM nation""")
def rewritten_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block between two markers of a guide made anew; the rest stays."""
    guide = F.lit("before <!-- BEGIN t --> old\nrows <!-- END t --> after <!-- BEGIN u --> kept <!-- END u -->")
    return load(spark, sf_dir, "nation").select("n_nationkey", F.regexp_replace(guide, F.lit(r"(?s)(<!-- BEGIN t -->).*?(<!-- END t -->)"), F.concat(F.lit("$1 "), "n_name", F.lit(" $2"))).alias("guide"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS stamp, '{"a":' || o_custkey || ',"b":"' || o_orderstatus || '","c":' || o_orderkey % 7 || '}' AS canonical, 3 AS n_keys FROM orders""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps merged, the later winning, and written with their keys in order."""
    text = lambda c: c.cast("string")
    first = F.create_map(F.lit("c"), F.lit("0"), F.lit("a"), text(F.col("o_custkey")))
    later = F.create_map(F.lit("c"), text(F.col("o_orderkey") % 7), F.lit("b"), F.concat(F.lit('"'), "o_orderstatus", F.lit('"')))
    merged = F.map_concat(F.map_filter(first, lambda k, v: ~F.map_contains_key(later, k)), later)
    body = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ","), F.lit("}"))
    return load(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("stamp"), body.alias("canonical"), F.size(merged).cast("bigint").alias("n_keys"))
