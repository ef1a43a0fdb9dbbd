"""Queries on keyed records: links and overrides, counts and logs, ordered rules, batches and the checks on chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import nodes as N
from ..operators import intervals, segment, sequences
from .outlines import LOCATED_SQL, located
from .relations import ASSIGNED_SQL, SPANS_SQL, SPLIT_ORDER, SPLITS_SQL, assigned, event_spans, since, split_table
from .tables import load
from .texts import LINES_SQL, PIECES_SQL, lines_of

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def first_of(rules: list[tuple[Column, str]], default: str) -> Column:
    """The name of the first rule that holds."""
    found = F.lit(default)
    for test, name in reversed(rules):
        found = F.when(test, name).otherwise(found)
    return found


# ---- links and overrides ---------------------------------------------------------------------------------------------

STRETCH_RANK = "CASE split WHEN 'dev' THEN 0 WHEN 'train' THEN 1 WHEN 'validation' THEN 2 WHEN 'test' THEN 3 END"


@query(f"""WITH {SPLITS_SQL}, p AS (SELECT o_orderkey, CAST(floor(o_totalprice / 500) AS BIGINT) - 50 AS a, CAST(floor(o_totalprice / 500) AS BIGINT) - 50 + 1 + o_orderkey % 90 AS b FROM orders)
    SELECT o_orderkey, max({STRETCH_RANK}) AS protection, count(spl.split) AS n_splits FROM p LEFT JOIN spl ON spl.a < p.b AND (spl.b IS NULL OR p.a < spl.b) GROUP BY o_orderkey""")
def stretch_protection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most protected split that a stretch of positions crosses; the splits are a rule table."""
    a = F.floor(F.col("o_totalprice") / 500) - 50
    rows = load(spark, sf_dir, "orders").select("o_orderkey", a.alias("a"), (a + 1 + F.col("o_orderkey") % 90).alias("b"))
    splits = F.broadcast(split_table(spark))
    rank = first_of([(F.col("split") == s, str(i)) for i, s in enumerate(SPLIT_ORDER[:-1])], "4").cast("int")
    crossed = rows.join(splits, (F.col("start_incl") < F.col("b")) & (F.col("end_excl").isNull() | (F.col("a") < F.col("end_excl"))), "left")
    return crossed.groupBy("o_orderkey").agg(F.max(F.when(F.col("split").isNotNull(), rank)).alias("protection"), F.count("split").alias("n_splits"))


@query("""WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN o_custkey + 10000000 ELSE o_custkey END AS anchor FROM orders)
    SELECT CASE WHEN anchor IS NULL THEN 'top' WHEN c_custkey IS NULL THEN 'unknown' ELSE c_mktsegment END AS bucket, count(*) AS n, count(DISTINCT anchor) AS n_anchors FROM d LEFT JOIN customer ON c_custkey = anchor GROUP BY 1""")
def attached_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts under the unit of their anchor; those without one under the top, those of an unknown one reported."""
    k = F.col("o_orderkey")
    anchor = F.when(k % 10 == 0, None).when(k % 13 == 0, F.col("o_custkey") + 10_000_000).otherwise(F.col("o_custkey"))
    drafts = load(spark, sf_dir, "orders").select(anchor.alias("anchor"))
    units = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("anchor"), "c_mktsegment")
    bucket = F.when(F.col("anchor").isNull(), "top").otherwise(F.coalesce("c_mktsegment", F.lit("unknown")))
    return drafts.join(units, "anchor", "left").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.countDistinct("anchor").alias("n_anchors"))


PARTS = [("front", 0, 1, 20), ("main", 1, 15, 35), ("none", 2, 900, 950)]


@query("""WITH r(part, ord, a, b) AS (VALUES ('front', 0, 1, 20), ('main', 1, 15, 35), ('none', 2, 900, 950)), w AS (SELECT p_partkey, p_size, (SELECT arg_min(part, ord) FROM r WHERE p_size BETWEEN a AND b) AS part FROM part)
    SELECT r.part, count(w.p_partkey) AS n, min(p_size) AS first, max(p_size) AS last, CASE WHEN count(w.p_partkey) = 0 THEN 'empty-range' END AS note FROM r LEFT JOIN w ON w.part = r.part GROUP BY r.part
    UNION ALL SELECT 'outside', count(*), min(p_size), max(p_size), 'outside-every-range' FROM w WHERE part IS NULL""")
def range_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items under the first declared range that holds them; empty ranges and items outside are noted."""
    ranges = spark.createDataFrame(PARTS, "part string, ord int, a int, b int")
    items = load(spark, sf_dir, "part").select("p_partkey", "p_size")
    held = first_of([(F.col("p_size").between(a, b), name) for name, _, a, b in PARTS], "outside")
    sums = items.groupBy(held.alias("part")).agg(F.count("*").alias("n"), F.min("p_size").alias("first"), F.max("p_size").alias("last"))
    all_ = ranges.select("part").unionByName(spark.createDataFrame([("outside",)], "part string"))
    note = F.when(F.col("part") == "outside", "outside-every-range").when(F.col("n").isNull(), "empty-range")
    return all_.join(sums, "part", "left").withColumn("note", note).withColumn("n", F.coalesce("n", F.lit(0)))


@query("""SELECT CASE WHEN c_custkey IS NULL THEN 'not-in-tree' WHEN c_custkey % 7 = 0 THEN 'gap-' || c_custkey % 3 WHEN NOT (CAST(left(o_orderpriority, 1) AS BIGINT) IN (c_nationkey % 5 + 1, c_nationkey % 3 + 1)) THEN 'uncorroborated' WHEN c_acctbal > 0 THEN 'located' ELSE 'unlocated' END AS status, count(*) AS n
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey + CASE WHEN o_orderkey % 11 = 0 THEN 10000000 ELSE 0 END GROUP BY 1""")
def link_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a link between two outlines may be used: both ends there, no gap, a heading in common, a place known."""
    target = F.col("o_custkey") + F.when(F.col("o_orderkey") % 11 == 0, 10_000_000).otherwise(0)
    links = load(spark, sf_dir, "orders").select(target.alias("c_custkey"), F.array(F.substring("o_orderpriority", 1, 1).cast("long")).alias("names"))
    ends = load(spark, sf_dir, "customer").select("c_custkey", F.array((F.col("c_nationkey") % 5 + 1).cast("long"), (F.col("c_nationkey") % 3 + 1).cast("long")).alias("own"), "c_acctbal")
    status = (
        F.when(F.col("own").isNull(), "not-in-tree").when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("gap-"), (F.col("c_custkey") % 3).cast("string")))
        .when(~F.arrays_overlap("names", "own"), "uncorroborated").when(F.col("c_acctbal") > 0, "located").otherwise("unlocated")
    )
    return links.join(ends, "c_custkey", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT coalesce(a.k, b.k) % 5 AS part, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS joined, count(*) FILTER (b.k IS NULL) AS only_notes, count(*) FILTER (a.k IS NULL) AS only_apparatus
    FROM (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey % 7 <> 0) a FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_partkey % 3 = 0) b ON a.k = b.k GROUP BY 1""")
def note_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = load(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("a"))
    apparatus = load(spark, sf_dir, "lineitem").where("l_partkey % 3 = 0").select(F.col("l_orderkey").alias("k")).distinct().withColumn("b", F.lit(1))
    both = notes.join(apparatus, "k", "full")
    return both.groupBy((F.col("k") % 5).alias("part")).agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("joined"), F.count_if(F.col("b").isNull()).alias("only_notes"), F.count_if(F.col("a").isNull()).alias("only_apparatus"))


@query("""SELECT l_partkey, l_suppkey, count(*) AS n, count(DISTINCT l_returnflag) = 1 AS agree FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to one request and task, and whether they agree: a group, not pairs."""
    found = load(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), (F.min("l_returnflag") == F.max("l_returnflag")).alias("agree"))
    return found.where("n > 1")


@query("""SELECT lang, coalesce(CAST(quality AS BIGINT), CASE WHEN n_chars > 500 THEN 1 ELSE 0 END) AS judged, count(*) AS n, count(quality) AS by_hand FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""")
def adjudicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    judged = F.coalesce(F.col("quality").cast("bigint"), F.when(F.col("n_chars") > 500, 1).otherwise(0).cast("bigint"))
    return rows.groupBy("lang", judged.alias("judged")).agg(F.count("*").alias("n"), F.count("quality").alias("by_hand"))


@query("""SELECT DISTINCT s_suppkey, c_custkey FROM supplier JOIN customer ON (s_nationkey = c_nationkey AND s_suppkey % 50 = c_custkey % 50) OR s_suppkey = c_custkey""")
def matches_by_any_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that agree in one key or another: an equi-join a key, made one; a single join on either would be a nested loop.

    Rows of one number are made one with all its nations, and a pair is given for the least nation in common, else for its equal
    numbers: so each comes once, and no pair is kept or shuffled to find that out. Joins are by sort, which holds one key's rows.
    """
    s, c = (load(spark, sf_dir, t).groupBy(F.col(k)).agg(F.array_sort(F.collect_set(n)).alias(f"{t[0]}_nations")) for t, k, n in (("supplier", "s_suppkey", "s_nationkey"), ("customer", "c_custkey", "c_nationkey")))
    by = lambda df, k, n: df.select("*", F.explode(n).alias("nation"), (F.col(k) % 50).alias("rest")).hint("merge")
    common = F.array_min(F.array_intersect("s_nations", "c_nations"))
    by_nation = by(s, "s_suppkey", "s_nations").join(by(c, "c_custkey", "c_nations"), ["nation", "rest"]).where((F.size("s_nations") == 1) | (F.size("c_nations") == 1) | (common == F.col("nation")))
    by_number = s.hint("merge").join(c, F.col("s_suppkey") == F.col("c_custkey")).where(~F.arrays_overlap("s_nations", "c_nations"))
    return by_nation.select("s_suppkey", "c_custkey").union(by_number.select("s_suppkey", "c_custkey"))


# ---- counts ----------------------------------------------------------------------------------------------------------


@query("""SELECT CASE WHEN n_chars < 300 THEN 'short' ELSE 'long' END AS bucket, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang <> 'en') AS other, count(*) FILTER (lang IS NULL) AS absent FROM documents GROUP BY 1""")
def heading_check_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("lang").isNull(), "absent").when(F.col("lang") == "en", "en").otherwise("other")
    rows = load(spark, sf_dir, "documents").select(F.when(F.col("n_chars") < 300, "short").otherwise("long").alias("bucket"), kind.alias("kind"))
    return rows.groupBy("bucket").pivot("kind", ["en", "other", "absent"]).count().fillna(0)


@query("""SELECT l_returnflag, count(*) AS n, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_suppliers, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY 1""")
def crosswalk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct = lambda c, n: F.countDistinct(c).alias(n)
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), distinct("l_partkey", "n_parts"), distinct("l_suppkey", "n_suppliers"), distinct("l_orderkey", "n_orders"))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority))""")
def case_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by kind, by source and by both in one pass."""
    rows = load(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority")
    kinds, sources = F.col("o_orderstatus"), F.col("o_orderpriority")
    return rows.groupingSets([[kinds], [sources], [kinds, sources]], kinds, sources).agg(F.count("*").alias("n"))


@query(f"""WITH {ASSIGNED_SQL} SELECT o_custkey, arg_min(o_orderkey, pos * 10000000 + o_orderkey) AS first_key, arg_max(o_orderkey, pos * 10000000 + o_orderkey) AS last_key, count(*) FILTER (split = 'dev') AS dev, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'test') AS test FROM asg GROUP BY o_custkey""")
def aligned_text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("pos", "o_orderkey")
    return assigned(spark, sf_dir).groupBy("o_custkey").agg(F.min_by("o_orderkey", at).alias("first_key"), F.max_by("o_orderkey", at).alias("last_key"), *(F.count_if(F.col("split") == s).alias(s) for s in ("dev", "train", "test")))


@query("""SELECT kind, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS kind FROM part) GROUP BY kind""")
def element_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(F.explode(F.split("p_type", " ")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN NOT regexp_matches(text, '[^\\x00-\\x7F]') THEN 'ascii' WHEN regexp_matches(text, '[\\x{0400}-\\x{FFFF}]') THEN 'wide' ELSE 'latin' END AS route, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY 1""")
def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which route each text takes: the first rule that holds."""
    t = F.col("text")
    route = first_of([(t.isNull() | (t == ""), "empty"), (~t.rlike(r"[^\x00-\x7F]"), "ascii"), (t.rlike(r"[\x{0400}-\x{FFFF}]"), "wide")], "latin")
    return load(spark, sf_dir, "documents").groupBy(route.alias("route")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query("""SELECT lang, v[least(n - 1, CAST(floor(0.5 * n) AS BIGINT)) + 1] AS p50, v[least(n - 1, CAST(floor(0.9 * n) AS BIGINT)) + 1] AS p90 FROM (SELECT lang, list(n_chars ORDER BY n_chars) AS v, count(*) AS n FROM documents GROUP BY lang)""")
def percentile_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value at floor(q * n) of the sorted ones: counts by value are summed up, so only distinct values are sorted."""
    counts = load(spark, sf_dir, "documents").groupBy("lang", "n_chars").agg(F.count("*").alias("k"))
    w = Window.partitionBy("lang")
    placed = counts.withColumn("upto", F.sum("k").over(w.orderBy("n_chars"))).withColumn("n", F.sum("k").over(w))
    at = lambda q: F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.lit(q) * F.col("n"))), F.col("n_chars")))
    return placed.groupBy("lang").agg(at(0.5).alias("p50"), at(0.9).alias("p90"))


@query("""SELECT source, lang, count(*) AS n, max(n_chars) AS longest, grouping(source) + 2 * grouping(lang) AS level FROM documents GROUP BY ROLLUP (source, lang)""")
def corpus_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = (F.grouping("source") + 2 * F.grouping("lang")).cast("bigint")
    return load(spark, sf_dir, "documents").rollup("source", "lang").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"), level.alias("level"))


@query("""SELECT role, count(*) AS n, max(length(text)) AS longest, CAST(sum(length(text)) AS BIGINT) AS total, round(avg(length(text)), 4) AS mean FROM conversations GROUP BY role""")
def request_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text").cast("bigint")
    return load(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.max(n).alias("longest"), F.sum(n).alias("total"), F.round(F.avg(n), 4).alias("mean"))


@query("""WITH t AS (SELECT doc_id, lang, quality, trial, lead(quality) OVER (PARTITION BY lang, trial ORDER BY md5(doc_id || '-0-' || trial), doc_id) AS other FROM documents JOIN labels USING (doc_id), range(0, 3) r(trial))
    SELECT lang, trial, count(*) FILTER (quality = other) AS agree, count(other) AS n FROM t GROUP BY ALL""")
def noise_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels against those of another document of the language, paired by a hash of id, seed and trial."""
    rows = load(spark, sf_dir, "documents").select("doc_id", "lang").join(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    trials = rows.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<bigint>")))
    order = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("-0-"), F.col("trial").cast("string")).cast("binary"))
    paired = trials.withColumn("other", F.lead("quality").over(Window.partitionBy("lang", "trial").orderBy(order, "doc_id")))
    return paired.groupBy("lang", "trial").agg(F.count_if(F.col("quality") == F.col("other")).alias("agree"), F.count("other").alias("n"))


# ---- order -----------------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_quantity AS BIGINT) // 10, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_linenumber, l_partkey, l_suppkey) AS seq FROM lineitem""")
def elements_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements by line, rank of kind and sequence."""
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    w = Window.partitionBy("l_orderkey").orderBy(F.floor(F.col("l_quantity") / 10), rank, "l_linenumber", "l_partkey", "l_suppkey")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.row_number().over(w).cast("bigint").alias("seq"))


@query("""WITH v AS (SELECT o_orderpriority AS code, o_orderkey FROM orders WHERE o_totalprice < 100000) SELECT code, o_orderkey, n FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY code) AS n FROM v) WHERE r <= 25""")
def first_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 findings of each code, and how many there are: a limit that the report asks for."""
    found = load(spark, sf_dir, "orders").where("o_totalprice < 100000").select(F.col("o_orderpriority").alias("code"), "o_orderkey")
    counts = found.groupBy("code").agg(F.count("*").alias("n"))
    first = found.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("o_orderkey"))).where("r <= 25").drop("r")
    return first.join(F.broadcast(counts), "code")  # a row a code


@query(f"""WITH {LINES_SQL}, h AS (SELECT doc_id, line_no FROM lo WHERE contains(line, 'the')) SELECT a.doc_id, a.line_no, b.line_no AS found FROM lo a JOIN h b ON a.doc_id = b.doc_id AND abs(b.line_no - a.line_no) <= 2 WHERE a.line_no % 3 = 0
    QUALIFY row_number() OVER (PARTITION BY a.doc_id, a.line_no ORDER BY abs(b.line_no - a.line_no), b.line_no < a.line_no) = 1""")
def nearby_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest line with the needle within two lines, the later one of two as near."""
    lines = lines_of(spark, sf_dir)
    probes = lines.where("line_no % 3 = 0").select("doc_id", "line_no")
    hits = lines.where(F.contains("line", F.lit("the"))).select("doc_id", F.col("line_no").alias("found"))
    both = intervals.within_band(probes, hits, ["doc_id"], "line_no", "found", 2)
    away = F.col("found") - F.col("line_no")
    return both.groupBy("doc_id", "line_no").agg(F.min_by("found", F.struct(F.abs(away), away < 0)).alias("found"))


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r % 10 = 0 UNION ALL SELECT doc_id, 'seeded' FROM documents WHERE left(md5(doc_id || '-7'), 1) = 'a'""")
def sampled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document of a language, and those that a seeded hash picks: sampling is the operator."""
    rows = load(spark, sf_dir, "documents").select("doc_id", "lang")
    every = rows.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where("r % 10 = 0").drop("r")
    seeded = rows.where(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("-7")).cast("binary")), 1, 1) == "a")
    return every.unionByName(seeded.select("doc_id", F.lit("seeded").alias("lang")))


@query(f"""WITH {SPANS_SQL}, z AS (SELECT user_id, min(s) AS zero FROM sp GROUP BY user_id), c AS (SELECT sp.user_id, greatest(s - zero - 1000, 0) AS a, least(e - zero - 1000, 2000000) AS b FROM sp JOIN z USING (user_id))
    SELECT user_id, pos FROM (SELECT user_id, a AS pos FROM c WHERE a < b UNION SELECT user_id, b FROM c WHERE a < b)""")
def span_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the spans, clipped to the text and not empty, each once."""
    spans = event_spans(spark, sf_dir)
    zero = spans.groupBy("user_id").agg(F.min("s").alias("zero"))
    clipped = spans.join(zero, "user_id").select("user_id", F.greatest(F.col("s") - F.col("zero") - 1000, F.lit(0)).alias("a"), F.least(F.col("e") - F.col("zero") - 1000, F.lit(2_000_000)).alias("b")).where("a < b")
    return clipped.select("user_id", F.explode(F.array("a", "b")).alias("pos")).distinct()


@query("""SELECT l_orderkey, min(q) AS low, max(q + s) AS high, count(*) AS n, max(q + s) - min(q) AS extent FROM (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS q, l_suppkey % 20 AS s FROM lineitem) GROUP BY l_orderkey""")
def range_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("bigint")
    found = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(q).alias("low"), F.max(q + F.col("l_suppkey") % 20).alias("high"), F.count("*").alias("n"))
    return found.withColumn("extent", F.col("high") - F.col("low"))


@query("""SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.08""")
def shared_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem")
    of = lambda test: rows.where(test).select("l_partkey")
    return of("l_returnflag = 'R'").intersect(of("l_returnflag = 'A'")).intersect(of("l_discount > 0.08"))


# ---- windows over statements -----------------------------------------------------------------------------------------


@query("""WITH g AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS a FROM events) SELECT user_id, min(event_id) AS anchor, count(*) AS n, round(sum(value), 4) AS size FROM g WHERE a > 0 GROUP BY user_id, a""")
def anchor_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each anchor to the next: how many marks and how much."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = load(spark, sf_dir, "events").withColumn("a", F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).over(w)).where("a > 0")
    return rows.groupBy("user_id", "a").agg(F.min("event_id").alias("anchor"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("size")).drop("a")


@query("""WITH p AS (SELECT *, epoch_ms(ts) AS ms, lag(event_type) OVER w AS k, lag(epoch_ms(ts)) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, CASE WHEN before IS NOT NULL AND ms - before <= 3600000 THEN k ELSE 'text' END AS after, coalesce(k = 'purchase' AND ms - before <= 3600000, false) AS unit_start FROM p""")
def statement_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of the statement right before, if nothing stands between, and whether a unit begins here."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ms = since("MILLISECOND", "ts")
    rows = load(spark, sf_dir, "events").select("event_id", F.lag("event_type").over(w).alias("k"), (ms - F.lag(ms).over(w)).alias("gap"))
    near = F.coalesce(F.col("gap") <= 3_600_000, F.lit(False))
    return rows.select("event_id", F.when(near, F.col("k")).otherwise("text").alias("after"), (near & (F.col("k") == "purchase")).alias("unit_start"))


@query("""WITH p AS (SELECT user_id, event_id, event_type, lead(event_type) OVER w AS k, lead(event_id) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, n AS with_event, n - event_id AS gap FROM p WHERE event_type <> k AND n - event_id <= 40""")
def adjacent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that a differing one follows within a gap: two made one."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.lead("event_type").over(w).alias("k"), F.lead("event_id").over(w).alias("with_event"))
    return rows.withColumn("gap", F.col("with_event") - F.col("event_id")).where("event_type <> k AND gap <= 40").drop("event_type", "k")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN 'p' || event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS label FROM events""")
def previous_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("event_type") == "purchase", F.concat(F.lit("p"), F.col("event_id").cast("string")))
    return load(spark, sf_dir, "events").select("event_id", F.last(mark, ignorenulls=True).over(w).alias("label"))


@query("""SELECT user_id, count(*) AS n, max(g) AS largest, round(median(g), 4) AS middle FROM (SELECT user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events) WHERE g IS NOT NULL GROUP BY user_id""")
def start_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.col("event_id") - F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = load(spark, sf_dir, "events").select("user_id", gap.alias("g")).where("g IS NOT NULL")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.max("g").alias("largest"), F.round(F.median("g"), 4).alias("middle"))


@query("""SELECT event_id, user_id, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 THEN 'new' ELSE 'recompute' END AS kind, round(sum(abs(value)) OVER (PARTITION BY user_id ORDER BY event_id), 4) <= 300 AS within_budget FROM events""")
def look_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a look at a (user, kind) is its first, and whether the running total stays within the budget."""
    first = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id")) == 1
    total = F.sum(F.abs("value")).over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    return load(spark, sf_dir, "events").select("event_id", "user_id", F.when(first, "new").otherwise("recompute").alias("kind"), (F.round(total, 4) <= 300).alias("within_budget"))


# ---- requests, rules and states --------------------------------------------------------------------------------------


@query("""SELECT CASE WHEN regexp_matches(url, '^https?://[^/]*/?$') THEN 'home' WHEN contains(url, '?') THEN 'query' WHEN regexp_matches(url, '[0-9]') THEN 'numbered' WHEN starts_with(url, 'https') THEN 'secure' ELSE 'other' END AS kind, count(*) AS n FROM pages GROUP BY 1""")
def path_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    kinds = [(url.rlike("^https?://[^/]*/?$"), "home"), (F.contains(url, F.lit("?")), "query"), (url.rlike("[0-9]"), "numbered"), (F.startswith(url, F.lit("https")), "secure")]
    return load(spark, sf_dir, "pages").groupBy(first_of(kinds, "other").alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, CASE WHEN n BETWEEN 1 AND 151 THEN 'A' WHEN n BETWEEN 152 AND 219 THEN 'B' WHEN n BETWEEN 262 AND 277 THEN 'C' END AS part FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN p_partkey % 400 END AS n FROM part)""")
def number_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of a work by its number's range; null for another form or a number in none."""
    work = F.concat(F.when(F.col("p_partkey") % 9 == 0, "X").otherwise("T"), F.lpad((F.col("p_partkey") % 400).cast("string"), 4, "0"), F.lit("a"))
    n = F.nullif(F.regexp_extract(work, r"^T(\d+)", 1), F.lit("")).cast("int")
    return load(spark, sf_dir, "part").select("p_partkey", F.when(n.between(1, 151), "A").when(n.between(152, 219), "B").when(n.between(262, 277), "C").alias("part"))


@query(f"""WITH {LINES_SQL} SELECT doc_id, count(*) FILTER (m) AS n_marked, count(*) AS n_lines, count(*) FILTER (m) >= 2 AND count(*) FILTER (m) >= 0.5 * count(*) AS is_chart FROM (SELECT doc_id, regexp_matches(line, '^[A-Z0-9]') AS m FROM lo) GROUP BY doc_id""")
def chart_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines_of(spark, sf_dir).groupBy("doc_id").agg(F.count_if(F.col("line").rlike("^[A-Z0-9]")).alias("n_marked"), F.count("*").alias("n_lines"))
    return found.withColumn("is_chart", (F.col("n_marked") >= 2) & (F.col("n_marked") >= 0.5 * F.col("n_lines")))


@query("""WITH a AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_returnflag) AS kinds FROM lineitem WHERE l_linenumber > 2 GROUP BY 1) SELECT CASE WHEN n IS NULL AND o_orderstatus = 'P' THEN 'deferred' WHEN n IS NULL THEN 'open' WHEN kinds > 1 THEN 'invalid' WHEN n > 1 THEN 'duplicate' ELSE 'answered' END AS state, count(*) AS n FROM orders LEFT JOIN a ON l_orderkey = o_orderkey GROUP BY 1""")
def request_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = load(spark, sf_dir, "lineitem").where("l_linenumber > 2").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.countDistinct("l_returnflag").alias("kinds"))
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(answers, "o_orderkey", "left")
    none = F.col("n").isNull()
    state = first_of([(none & (F.col("o_orderstatus") == "P"), "deferred"), (none, "open"), (F.col("kinds") > 1, "invalid"), (F.col("n") > 1, "duplicate")], "answered")
    return rows.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT c_nationkey AS k, c_mktsegment AS s, count(*) AS v FROM customer WHERE c_custkey % 10 <> 0 GROUP BY ALL), b AS (SELECT c_nationkey AS k, c_mktsegment AS s, count(*) AS v FROM customer WHERE c_acctbal > 0 GROUP BY ALL)
    SELECT coalesce(a.k, b.k) AS k, coalesce(a.s, b.s) AS s, a.v AS before, b.v AS now, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'gone' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k AND a.s = b.s""")
def runs_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two score runs row by row."""
    rows = load(spark, sf_dir, "customer")
    of = lambda test, n: rows.where(test).groupBy(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("s")).agg(F.count("*").alias(n))
    both = of("c_custkey % 10 <> 0", "before").join(of("c_acctbal > 0", "now"), ["k", "s"], "full")
    change = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "gone").when(F.col("before") == F.col("now"), "same").otherwise("changed")
    return both.withColumn("change", change)


@query("""SELECT o_orderkey, o_custkey, bool_and(o_orderstatus <> 'P') OVER (PARTITION BY o_custkey) AS released FROM orders""")
def look_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row is held until every arm of its set can be scored; the sets are reduced, then joined."""
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    sets = rows.groupBy("o_custkey").agg(F.every(F.col("o_orderstatus") != "P").alias("released"))
    return rows.join(sets, "o_custkey").select("o_orderkey", "o_custkey", "released")


@query("""SELECT conv_id, turn, sha256('{"role":"' || role || '","text_sha":"' || sha256(text) || '","turn":' || turn || '}') AS request FROM conversations""")
def request_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of canonical JSON: keys in order, no blanks."""
    body = F.to_json(F.struct("role", F.sha2("text", 256).alias("text_sha"), "turn"))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(body, 256).alias("request"))


@query("""WITH RECURSIVE c AS (SELECT conv_id, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations), g AS (SELECT conv_id, k, CAST(0 AS BIGINT) AS b, CAST(n AS BIGINT) AS size FROM c WHERE k = 0
    UNION ALL SELECT c.conv_id, c.k, g.b + CASE WHEN g.size > 0 AND g.size + c.n > 300 THEN 1 ELSE 0 END, CASE WHEN g.size > 0 AND g.size + c.n > 300 THEN c.n ELSE g.size + c.n END FROM g JOIN c ON c.conv_id = g.conv_id AND c.k = g.k + 1)
    SELECT g.conv_id, b AS batch, count(*) AS n, CAST(sum(c.n) AS BIGINT) AS n_chars FROM g JOIN c USING (conv_id, k) GROUP BY g.conv_id, b""")
def request_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a conversation in batches under a budget of characters."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = load(spark, sf_dir, "conversations").select("conv_id", (F.row_number().over(w) - 1).alias("k"), F.length("text").alias("n"))
    found = sequences.line_windows(rows, ["conv_id"], "k", "n", 300)
    return found.select("conv_id", F.col("window").alias("batch"), (F.col("last") - F.col("first") + 1).alias("n"), "n_chars")


@query("""SELECT coalesce(CASE WHEN conv_id IS NULL THEN 'no id' END, CASE WHEN role NOT IN ('user', 'assistant') THEN 'role ' || role END, CASE WHEN text IS NULL OR trim(text) = '' THEN 'no text' END, CASE WHEN length(text) > 200 THEN 'too long' END, 'fits') AS finding, count(*) AS n FROM conversations GROUP BY 1""")
def request_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    finding = (
        F.when(F.col("conv_id").isNull(), "no id").when(~F.col("role").isin("user", "assistant"), F.concat(F.lit("role "), "role"))
        .when(F.col("text").isNull() | (F.trim("text") == ""), "no text").when(F.length("text") > 200, "too long").otherwise("fits")
    )
    return load(spark, sf_dir, "conversations").groupBy(finding.alias("finding")).agg(F.count("*").alias("n"))


@query("""SELECT n_regionkey, n_nationkey, CASE WHEN f THEN NULL ELSE n_nationkey END AS start, e AS end_excl FROM (SELECT n_regionkey, n_nationkey, lead(n_nationkey) OVER w AS e, row_number() OVER w = 1 AS f FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)) WHERE n_nationkey % 3 <> 2""")
def served_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Served parts of a file from their start to the next part's; a served first part is open before."""
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    rows = load(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", F.lead("n_nationkey").over(w).alias("end_excl"), (F.row_number().over(w) == 1).alias("first"))
    return rows.where("n_nationkey % 3 <> 2").select("n_regionkey", "n_nationkey", F.when(~F.col("first"), F.col("n_nationkey")).alias("start"), "end_excl")


@query(f"""WITH {LOCATED_SQL} SELECT l_orderkey, l_partkey, l_suppkey, q, CASE WHEN l_linenumber % 2 = 0 OR (l_linenumber % 3 = 0 AND explained IS NOT NULL) THEN CASE WHEN coalesce(announced = explained AND contains(announced, ':'), false) THEN NULL ELSE explained END ELSE root_start END AS pos FROM loc""")
def node_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a node stands in the target: in the text that states it where it is explained, unless listed only; in the root where its span starts."""
    stated = (F.col("l_linenumber") % 2 == 0) | ((F.col("l_linenumber") % 3 == 0) & F.col("explained").isNotNull())
    listed = N.listed_only(F.col("announced"), F.col("explained"))
    return located(spark, sf_dir).select("l_orderkey", "l_partkey", "l_suppkey", "q", F.when(stated, F.when(~listed, F.col("explained"))).otherwise(F.col("root_start")).alias("pos"))


@query("""SELECT page_id, count(*) AS n, count(DISTINCT link) AS n_links, min(link) AS least FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) GROUP BY page_id""")
def link_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("link"))
    return rows.groupBy("page_id").agg(F.count("*").alias("n"), F.countDistinct("link").alias("n_links"), F.min("link").alias("least"))


# ---- checks on chunks ------------------------------------------------------------------------------------------------


@query(f"""WITH {PIECES_SQL} SELECT doc_id, sent_no, s // 200 AS chunk_no, (e - 1) // 200 AS last_chunk FROM (SELECT doc_id, sent_no, char_end_excl - n AS s, char_end_excl AS e FROM o) WHERE s // 200 <> (e - 1) // 200""")
def chunk_inv_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that straddle chunks: the chunks of their first and their last character differ. The chunks are cut every
    200 characters, without regard for sentences, so that there is something to find."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    chunks = docs.where(F.length("text") > 0).select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.length("text") - 1) / 200))).alias("chunk_no")).withColumn("at", F.col("chunk_no") * 200)
    rows = segment.sentences(docs).select("doc_id", "sent_no", "char_start", (F.col("char_end_excl") - 1).alias("last"))
    first = intervals.as_of(rows, chunks, ["doc_id"], "char_start", "at", ["chunk_no"])
    last = intervals.as_of(first, chunks.withColumnRenamed("chunk_no", "last_chunk"), ["doc_id"], "last", "at", ["last_chunk"])
    return last.where("chunk_no <> last_chunk").select("doc_id", "sent_no", "chunk_no", "last_chunk")


@query(f"""WITH {LINES_SQL}, c AS (SELECT doc_id, line_no, char_start AS s, char_start + n AS e FROM lo WHERE n > 0), k AS (SELECT doc_id, line_no, x AS chunk_no FROM (SELECT *, unnest(range(s // 150, (e - 1) // 150 + 1)) AS x FROM c))
    SELECT doc_id, line_no, count(*) AS n_chunks FROM k GROUP BY ALL HAVING count(*) > 1""")
def chunk_inv_leaf_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that more than one chunk overlaps, with how many."""
    spans = lines_of(spark, sf_dir).select("doc_id", "line_no", F.col("char_start").alias("s"), (F.col("char_start") + F.length("line")).alias("e")).where("s < e")
    n = F.floor((F.col("e") - 1) / 150) - F.floor(F.col("s") / 150) + 1
    return spans.select("doc_id", "line_no", n.alias("n_chunks")).where("n_chunks > 1")


@query(f"""WITH {LINES_SQL}, u AS (SELECT doc_id, line_no // 4 AS parent, unnest(range(char_start // 150, (char_start + n - 1) // 150 + 1)) AS chunk_no FROM lo WHERE n > 0) SELECT doc_id, chunk_no, count(DISTINCT parent) AS n_parents FROM u GROUP BY ALL HAVING count(DISTINCT parent) > 1""")
def chunk_inv_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that hold units of different parents; every four lines have one parent."""
    units = lines_of(spark, sf_dir).where(F.length("line") > 0).select("doc_id", F.floor(F.col("line_no") / 4).alias("parent"), F.explode(F.sequence(F.floor(F.col("char_start") / 150), F.floor((F.col("char_start") + F.length("line") - 1) / 150))).alias("chunk_no"))
    return units.groupBy("doc_id", "chunk_no").agg(F.countDistinct("parent").alias("n_parents")).where("n_parents > 1")


@query("""WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events) SELECT user_id, event_type AS value, count(DISTINCT g) AS visits FROM r GROUP BY ALL HAVING count(DISTINCT g) > 1""")
def chunk_inv_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are returned to after having been left."""
    found = intervals.runs(load(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type"))
    return found.groupBy("user_id", "value").agg(F.count("*").alias("visits")).where("visits > 1")


@query("""SELECT CASE WHEN sha256(text) <> sha256(text || CASE WHEN doc_id % 9 = 0 THEN '!' ELSE '' END) THEN 'sha256' WHEN length(text) <> length(text) + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END THEN 'length' ELSE 'met' END AS contract, count(*) AS n FROM documents GROUP BY 1""")
def input_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text is the one that its manifest names: hash, then length."""
    k = F.col("doc_id")
    docs = load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("own"), F.length("text").alias("n"))
    manifest = load(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat("text", F.when(k % 9 == 0, "!").otherwise("")), 256).alias("sha"), (F.length("text") + F.when(k % 7 == 0, 1).otherwise(0)).alias("length"))
    state = F.when(F.col("own") != F.col("sha"), "sha256").when(F.col("n") != F.col("length"), "length").otherwise("met")
    return docs.join(manifest, "doc_id").groupBy(state.alias("contract")).agg(F.count("*").alias("n"))


@query(f"""WITH {PIECES_SQL} SELECT doc_id, sha256(string_agg(sentence, '' ORDER BY sent_no)) = any_value(digest) AS same, any_value(digest) AS digest FROM o JOIN (SELECT doc_id, sha256(text) AS digest FROM documents) USING (doc_id) GROUP BY doc_id""")
def concatenated_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of a text put together are the text."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = F.array_sort(F.collect_list(F.struct("sent_no", "sentence")))
    whole = segment.sentences(docs).groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(pieces, lambda x: x["sentence"]), ""), 256).alias("back"))
    return whole.join(docs.select("doc_id", F.sha2("text", 256).alias("digest")), "doc_id").select("doc_id", (F.col("back") == F.col("digest")).alias("same"), "digest")


@query(f"""WITH {LINES_SQL}, k AS (SELECT doc_id, line_no, line, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM lo WHERE line_no % 3 <> 2), r AS (SELECT doc_id, min(line_no) AS a, string_agg(line, '' ORDER BY line_no) AS t FROM k GROUP BY doc_id, g) SELECT doc_id, count(*) AS n_ranges, sha256(string_agg(t, '｜' ORDER BY a)) AS digest FROM r GROUP BY doc_id""")
def window_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a window put together, with a separator between ranges that don't touch."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    kept = lines_of(spark, sf_dir).where("line_no % 3 <> 2").withColumn("apart", F.coalesce(F.col("line_no") - F.lag("line_no").over(w) > 1, F.lit(False)))
    parts = F.array_sort(F.collect_list(F.struct("line_no", F.concat(F.when(F.col("apart"), "｜").otherwise(""), "line").alias("t"))))
    found = kept.groupBy("doc_id").agg((F.count_if("apart") + 1).alias("n_ranges"), F.sha2(F.array_join(F.transform(parts, lambda x: x["t"]), ""), 256).alias("digest"))
    return found


@query(f"""WITH {LINES_SQL} SELECT doc_id, line_no, CASE WHEN line_no * 3 <= n THEN char_start + line_no * 3 END AS pos FROM lo""")
def global_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, offset) to an offset in the text; null beyond the line's end."""
    at = F.col("line_no") * 3
    return lines_of(spark, sf_dir).select("doc_id", "line_no", F.when(at <= F.length("line"), F.col("char_start") + at).alias("pos"))


@query("""SELECT doc_id, CASE WHEN instr(substring(text, 101, 400), 'the') > 0 THEN 99 + instr(substring(text, 101, 400), 'the') END AS pos FROM documents""")
def first_hit_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest place of the needle that lies whole in [100, 500)."""
    at = F.instr(F.substring("text", 101, 400), F.lit("the"))
    return load(spark, sf_dir, "documents").select("doc_id", F.when(at > 0, at + 99).cast("bigint").alias("pos"))


@query(r"""SELECT doc_id, ref, count(*) AS n, count(*) FILTER (followed) AS n_followed FROM (SELECT doc_id, regexp_extract(m, '^([A-Z]{3}-[0-9]+)', 1) AS ref, regexp_matches(m, ' ') AS followed
    FROM (SELECT doc_id, unnest(regexp_extract_all('ABC-' || doc_id % 9 || ' x ABC-7, ' || coalesce(lang, '') || ' QRS-' || doc_id % 5 || ' ABC-' || doc_id % 9, '[A-Z]{3}-[0-9]+ ?')) AS m FROM documents)) GROUP BY ALL""")
def mentioned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References named in free text, and how often text follows them."""
    k, text = F.col("doc_id"), lambda c: c.cast("string")
    said = F.concat(F.lit("ABC-"), text(k % 9), F.lit(" x ABC-7, "), F.coalesce("lang", F.lit("")), F.lit(" QRS-"), text(k % 5), F.lit(" ABC-"), text(k % 9))
    rows = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(said, F.lit("([A-Z]{3}-[0-9]+ ?)"), 1)).alias("m"))
    return rows.groupBy("doc_id", F.trim("m").alias("ref")).agg(F.count("*").alias("n"), F.count_if(F.endswith("m", F.lit(" "))).alias("n_followed"))
