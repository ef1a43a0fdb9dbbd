"""Queries on texts: normalisation, search, sentences and chunks, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import segment
from .tables import load, spread

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


PIECES_SQL = r"""
p AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?]+["'')\]]*[ \t\r\n]*)', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS l
      FROM documents),
s AS (SELECT doc_id, i - 1 AS sent_no, l[i] AS sentence FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM p)),
o AS (SELECT doc_id, sent_no, sentence, length(sentence) AS n,
      CAST(sum(length(sentence)) OVER (PARTITION BY doc_id ORDER BY sent_no) AS BIGINT) AS char_end_excl FROM s)
"""


@query(f"WITH {PIECES_SQL} SELECT doc_id, sent_no, char_end_excl - n AS char_start, char_end_excl, sha256(sentence) AS digest FROM o")
def seg_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment.sentences(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("digest", F.sha2("sentence", 256)).drop("sentence")


@query(f"""WITH {PIECES_SQL} SELECT doc_id, kind, count(*) AS n FROM (SELECT doc_id, CASE
    WHEN NOT regexp_matches(sentence, '[.!?]["'')\\]]*[ \\t\\r\\n]*$') THEN 'open'
    WHEN regexp_matches(sentence, '[?]["'')\\]]*[ \\t\\r\\n]*$') THEN 'question'
    WHEN regexp_matches(sentence, '[!]["'')\\]]*[ \\t\\r\\n]*$') THEN 'exclamation'
    WHEN length(trim(sentence)) <= 20 THEN 'short' ELSE 'statement' END AS kind FROM o) GROUP BY ALL""")
def seg_sentence_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, s = segment.sentences(load(spark, sf_dir, "documents").select("doc_id", "text")), F.col("sentence")
    ends = lambda marks: s.rlike(rf"[{marks}][\"')\]]*[ \t\r\n]*$")
    kind = F.when(~ends(".!?"), "open").when(ends("?"), "question").when(ends("!"), "exclamation").when(F.length(F.trim(s)) <= 20, "short").otherwise("statement")
    return found.groupBy("doc_id", kind.alias("kind")).agg(F.count("*").alias("n"))


LINES_SQL = """
l AS (SELECT doc_id, i - 1 AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i
      FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
lo AS (SELECT doc_id, line_no, line, length(line) AS n,
       CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) - length(line) - 1 AS char_start FROM l)
"""


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, line, char_start): lines with running offsets, line ends counted."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    placed = docs.withColumn("s", segment.starts_of(F.transform("l", lambda x: (F.length(x) + 1).cast("bigint"))))
    rows = placed.select("doc_id", F.posexplode(F.arrays_zip("l", "s")).alias("line_no", "x"))
    return rows.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("x.l").alias("line"), F.col("x.s").alias("char_start"))


@query(f"WITH {LINES_SQL} SELECT doc_id, line_no, char_start, n AS char_len FROM lo")
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(spark, sf_dir).select("doc_id", "line_no", "char_start", F.length("line").cast("bigint").alias("char_len"))


@query(f"""WITH {PIECES_SQL}, {LINES_SQL}
    SELECT o.doc_id, o.sent_no, lo.line_no, o.char_end_excl - o.n - lo.char_start AS line_offset
    FROM o ASOF JOIN lo ON o.doc_id = lo.doc_id AND o.char_end_excl - o.n >= lo.char_start""")
def locate_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.intervals import as_of

    probes = segment.sentences(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "sent_no", F.col("char_start").alias("at"))
    marks = lines_of(spark, sf_dir).select("doc_id", "line_no", "char_start")
    found = as_of(probes, marks, ["doc_id"], "at", "char_start", ["line_no", "char_start"], tie="line_no")
    return found.select("doc_id", "sent_no", "line_no", (F.col("at") - F.col("char_start")).alias("line_offset"))


@query(r"""SELECT doc_id, length(s) AS n_kept, length(text) - length(s) AS n_dropped, sha256(s) AS digest
    FROM (SELECT doc_id, text, regexp_replace(text, '[\p{P}\p{Z}\p{Cc}\p{Cf}]', '', 'g') AS s FROM documents)""")
def strip_punct_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", T.strip_punct(F.col("text")).alias("s"))
    n = F.length("s").cast("bigint")
    return docs.select("doc_id", n.alias("n_kept"), (F.length("text") - n).alias("n_dropped"), F.sha2("s", 256).alias("digest"))


@query("""SELECT doc_id, CAST(len(p) - 1 AS BIGINT) AS n_hits, CASE WHEN len(p) > 1 THEN length(p[1]) END AS first_hit, CASE WHEN len(p) > 1 THEN length(text) - length(p[len(p)]) - 2 END AS last_hit FROM (SELECT doc_id, text, string_split(text, 'th') AS p FROM documents)""")
def find_all_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = load(spark, sf_dir, "documents").select("doc_id", T.hits(F.col("text"), F.lit("th")).alias("h"))
    at = lambda k: F.try_element_at("h", F.lit(k)).cast("bigint")
    return found.select("doc_id", F.size("h").cast("bigint").alias("n_hits"), at(1).alias("first_hit"), at(-1).alias("last_hit"))


@query(r"""WITH k AS (SELECT doc_id, text, regexp_replace(text, '[\p{P}\p{Z}\p{Cc}\p{Cf}]', '', 'g') AS s FROM documents), h AS (SELECT doc_id, len(string_split(s, 'nt')) - 1 AS n, instr(text, regexp_extract(text, 'n[\p{P}\p{Z}\p{Cc}\p{Cf}]*t')) AS hit, length(regexp_extract(text, 'n[\p{P}\p{Z}\p{Cc}\p{Cf}]*t')) AS m FROM k)
    SELECT doc_id, CAST(n AS BIGINT) AS n_hits, CASE WHEN n > 0 THEN hit - 1 END AS first_start, CASE WHEN n > 0 THEN hit - 1 + m END AS first_end_excl FROM h""")
def find_hits_ignore_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    found = docs.select("doc_id", T.hits(T.strip_punct(F.col("text")), F.lit("nt")).alias("h"), T.first_bare_hit(F.col("text"), "nt").alias("p"))
    return found.select("doc_id", F.size("h").cast("bigint").alias("n_hits"), F.col("p.start").cast("bigint").alias("first_start"), F.col("p.end_excl").cast("bigint").alias("first_end_excl"))


@query("""WITH n AS (SELECT DISTINCT p_name AS x, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part),
    l AS (SELECT DISTINCT a AS label FROM n UNION SELECT DISTINCT b FROM n)
    SELECT x, label, round(CASE WHEN x = '' OR label = '' THEN 0.0 WHEN x = label THEN 1.0
        WHEN length(label) = 1 THEN CASE WHEN starts_with(x, label) OR ends_with(x, label) THEN 0.9 ELSE 0.0 END
        WHEN contains(x, label) OR contains(label, x) THEN CASE WHEN 2 * least(length(x), length(label)) >= greatest(length(x), length(label)) THEN 0.9 ELSE 0.6 END
        ELSE coalesce(CAST(len(list_filter(list_distinct(string_split(label, '')), lambda c: contains(x, c))) AS DOUBLE) / len(list_distinct(string_split(label, ''))), 0) END, 6) AS sim FROM n JOIN l ON left(label, 1) IN (left(a, 1), left(b, 1))""")
def label_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names against the words of all names that begin with the same letter as one of their own words."""
    names = load(spark, sf_dir, "part").select(F.col("p_name").alias("x")).distinct()
    labels = names.select(F.explode(F.split("x", " ")).alias("label")).distinct().withColumn("initial", F.substring("label", 1, 1))
    initials = names.select("x", F.explode(F.array_distinct(F.transform(F.split("x", " "), lambda w: F.substring(w, 1, 1)))).alias("initial"))
    pairs = initials.join(labels, "initial")
    return pairs.select("x", "label", F.round(T.label_similarity(F.col("x"), F.col("label")), 6).alias("sim"))


@query(r"""SELECT c_custkey, lower(trim(regexp_replace(regexp_replace(regexp_replace(h, '\([^)]*\)|\[[^\]]*\]', '', 'g'), '^[ \t]*[0-9]+([.-][0-9]+)*[.):]?[ \t]+', ''), '[ \t#]+[0-9]+[ \t]*$', ''))) AS name,
    TRY_CAST(nullif(regexp_extract(h, '[(\[ ]([0-9]+)[)\]]?$', 1), '') AS BIGINT) AS announced
    FROM (SELECT c_custkey, (c_custkey % 7) || '.' || (c_custkey % 3) || ' ' || c_mktsegment || ' [x] ' || c_name || ' (' || (c_custkey % 11) || ')' AS h FROM customer)""")
def title_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, text = F.col("c_custkey"), lambda c: c.cast("string")
    heading = F.concat(text(key % 7), F.lit("."), text(key % 3), F.lit(" "), "c_mktsegment", F.lit(" [x] "), "c_name", F.lit(" ("), text(key % 11), F.lit(")"))
    rows = load(spark, sf_dir, "customer").select("c_custkey", heading.alias("h"))
    return rows.select("c_custkey", T.title_name(F.col("h")).alias("name"), T.trailing_count(F.col("h")).alias("announced"))


@query("""SELECT c_custkey, n, CASE WHEN n < 100 THEN below ELSE '一百' || CASE WHEN t = 0 AND u > 0 THEN '零' ELSE '' END || below END AS written, n AS value FROM (
    SELECT *, CASE WHEN t = 0 THEN '' WHEN t = 1 AND n < 100 THEN '十' ELSE substring('一二三四五六七八九', t, 1) || '十' END || CASE WHEN u = 0 THEN '' ELSE substring('一二三四五六七八九', u, 1) END AS below
    FROM (SELECT c_custkey, n, (n % 100) // 10 AS t, n % 10 AS u FROM (SELECT c_custkey, c_custkey % 199 + 1 AS n FROM customer)))""")
def numeral_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 199 + 1).alias("n"))
    written = rows.withColumn("written", T.numeral(F.col("n")))
    return written.withColumn("value", T.numeral_value(F.col("written")).cast("bigint"))


@query("SELECT doc_id, sha256(text) AS digest, strlen(text) AS n_bytes, length(text) AS n_chars, sha256(lang || '|' || source) AS facets FROM documents")
def sha256_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2(t, 256).alias("digest"), F.octet_length(t).cast("bigint").alias("n_bytes"), F.length(t).cast("bigint").alias("n_chars"), F.sha2(F.concat_ws("|", "lang", "source"), 256).alias("facets"))


@query("""SELECT l_orderkey, l_linenumber, 'T' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') || 'n' || l_partkey AS file, CAST(l_quantity AS INTEGER) AS page, 'a' AS register, l_linenumber AS line,
    CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END AS char_offset FROM lineitem""")
def locator_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    ref = F.concat(F.lit("T"), F.lpad(text("l_suppkey"), 6, "0"), F.lit("n"), text("l_partkey"), F.lit("_p"), F.lpad(F.col("l_quantity").cast("int").cast("string"), 4, "0"), F.lit("a"), F.lpad(text("l_linenumber"), 2, "0"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(":"), text("l_linenumber"))).otherwise(""))
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.locator(ref).alias("x"))
    return rows.select("l_orderkey", "l_linenumber", "x.file", "x.page", "x.register", "x.line", F.col("x.offset").alias("char_offset"))


PACK_SQL = f"""
WITH RECURSIVE {PIECES_SQL},
g(doc_id, sent_no, w, k, c) AS (
    SELECT doc_id, sent_no, CAST(0 AS BIGINT), CAST(1 AS BIGINT), CAST(n AS BIGINT) FROM o WHERE sent_no = 0
    UNION ALL
    SELECT o.doc_id, o.sent_no, g.w + CASE WHEN g.k + 1 <= 6 AND g.c + o.n <= 180 THEN 0 ELSE 1 END,
        CASE WHEN g.k + 1 <= 6 AND g.c + o.n <= 180 THEN g.k + 1 ELSE 1 END, CASE WHEN g.k + 1 <= 6 AND g.c + o.n <= 180 THEN g.c + o.n ELSE o.n END
    FROM g JOIN o ON o.doc_id = g.doc_id AND o.sent_no = g.sent_no + 1),
c AS (SELECT o.doc_id, g.w AS chunk_no, min(o.sent_no) AS first_sentence, count(*) AS n_sentences, min(o.char_end_excl - o.n) AS char_start,
    max(o.char_end_excl) AS char_end_excl, CAST(sum(o.n) AS BIGINT) AS n_chars FROM o JOIN g USING (doc_id, sent_no) GROUP BY o.doc_id, g.w)
"""


def chunks(spark: SparkSession, sf_dir: str, **rules) -> DataFrame:
    return segment.chunked(load(spark, sf_dir, "documents").select("doc_id", "text"), **rules)


@query(PACK_SQL + "SELECT * FROM c")
def chunk_pack_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir)


BALANCED_SQL = f"""
WITH RECURSIVE {PIECES_SQL},
g(doc_id, cap, sent_no, w, k, c) AS (
    SELECT doc_id, cap, sent_no, CAST(0 AS BIGINT), CAST(1 AS BIGINT), CAST(n AS BIGINT) FROM o, range(1, 7) r(cap) WHERE sent_no = 0
    UNION ALL
    SELECT o.doc_id, g.cap, o.sent_no, g.w + CASE WHEN g.k + 1 <= g.cap AND g.c + o.n <= 180 THEN 0 ELSE 1 END,
        CASE WHEN g.k + 1 <= g.cap AND g.c + o.n <= 180 THEN g.k + 1 ELSE 1 END, CASE WHEN g.k + 1 <= g.cap AND g.c + o.n <= 180 THEN g.c + o.n ELSE o.n END
    FROM g JOIN o ON o.doc_id = g.doc_id AND o.sent_no = g.sent_no + 1),
m AS (SELECT doc_id, cap, max(w) + 1 AS windows, count(*) AS sentences FROM g GROUP BY doc_id, cap),
b AS (SELECT m.doc_id, coalesce(min(m.cap) FILTER (m.windows = f.windows AND f.windows >= 2 AND m.cap >= greatest(1, ceil(f.sentences / f.windows))), 6) AS cap FROM m JOIN m f ON f.doc_id = m.doc_id AND f.cap = 6 GROUP BY m.doc_id)
SELECT o.doc_id, g.w AS chunk_no, min(o.sent_no) AS first_sentence, count(*) AS n_sentences, min(o.char_end_excl - o.n) AS char_start, max(o.char_end_excl) AS char_end_excl, CAST(sum(o.n) AS BIGINT) AS n_chars
FROM o JOIN g USING (doc_id, sent_no) JOIN b ON b.doc_id = o.doc_id AND b.cap = g.cap GROUP BY o.doc_id, g.w
"""


@query(BALANCED_SQL)
def chunk_pack_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir, balanced=True)


@query(PACK_SQL + """SELECT doc_id, CAST(sum(n_sentences) AS BIGINT) AS n_sentences, count(*) AS n_chunks, max(n_chars) AS max_chars, median(n_chars) AS median_chars,
    count(*) FILTER (n_chars > 180 OR n_sentences > 6) AS over_budget FROM c GROUP BY doc_id""")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.chunk_stats(chunks(spark, sf_dir))


@query("SELECT doc_id, length(text) AS covered, CAST(0 AS BIGINT) AS n_gaps, CAST(0 AS BIGINT) AS n_overlaps FROM documents WHERE text <> ''")
def chunk_inv_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("char_end_excl").over(Window.partitionBy("doc_id").orderBy("chunk_no"))
    rows = chunks(spark, sf_dir).withColumn("before", F.coalesce(before, F.lit(0)))
    return rows.groupBy("doc_id").agg(F.sum("n_chars").alias("covered"), F.count_if(F.col("char_start") > F.col("before")).alias("n_gaps"), F.count_if(F.col("char_start") < F.col("before")).alias("n_overlaps"))


@query(PACK_SQL + "SELECT doc_id, chunk_no FROM c WHERE n_sentences > 5 OR (n_chars > 150 AND n_sentences > 1)")
def chunk_inv_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks over a size: those packed for six sentences and 180 characters, held against five and 150, so that there is something to find."""
    over = (F.col("n_sentences") > 5) | ((F.col("n_chars") > 150) & (F.col("n_sentences") > 1))
    return chunks(spark, sf_dir).where(over).select("doc_id", "chunk_no")


@query(f"""WITH {PIECES_SQL} SELECT doc_id, count(*) AS n_sentences, CAST(sum(score) AS BIGINT) AS total, count(*) FILTER (score >= 2) AS n_accepted,
    max(score) AS best FROM (SELECT doc_id, CASE WHEN length(trim(sentence)) >= 20 THEN 1 ELSE 0 END + CASE WHEN contains(sentence, ',') THEN 1 ELSE 0 END
    + CASE WHEN regexp_matches(sentence, '[0-9]') THEN 1 ELSE 0 END - CASE WHEN regexp_matches(sentence, '[|#$%&*]') THEN 2 ELSE 0 END
    - CASE WHEN sentence = upper(sentence) THEN 1 ELSE 0 END AS score FROM o) GROUP BY doc_id""")
def additive_score_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("sentence")
    terms = [(1, F.length(F.trim(s)) >= 20), (1, F.contains(s, F.lit(","))), (1, s.rlike("[0-9]")), (-2, s.rlike("[|#$%&*]")), (-1, s == F.upper(s))]
    score = sum((F.when(test, points).otherwise(0) for points, test in terms), F.lit(0))
    rows = segment.sentences(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", score.alias("score"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum("score").alias("total"), F.count_if(F.col("score") >= 2).alias("n_accepted"), F.max("score").alias("best"))


@query(f"""WITH {LINES_SQL} SELECT doc_id, line_no, len(items) AS n_items, items[1] AS first_item, items[len(items)] AS last_item
    FROM (SELECT doc_id, line_no, list_filter(list_transform(string_split(line, '|'), lambda x: trim(x)), lambda x: x <> '') AS items FROM lo WHERE contains(line, ' | ')) WHERE len(items) >= 3""")
def listing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.filter(F.transform(F.split("line", "\\|"), lambda x: F.trim(x)), lambda x: x != "")
    rows = lines_of(spark, sf_dir).where(F.contains(F.col("line"), F.lit(" | "))).select("doc_id", "line_no", items.alias("items")).where(F.size("items") >= 3)
    return rows.select("doc_id", "line_no", F.size("items").cast("bigint").alias("n_items"), F.element_at("items", 1).alias("first_item"), F.element_at("items", -1).alias("last_item"))


@query(r"""SELECT doc_id, name, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[.!?][ \n]+)([A-Z][a-z]+),', 1)) AS name FROM documents) GROUP BY ALL""")
def attribution_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.explode(F.regexp_extract_all("text", F.lit(r"(?:^|[.!?][ \n]+)([A-Z][a-z]+),"), 1))
    return load(spark, sf_dir, "documents").select("doc_id", names.alias("name")).groupBy("doc_id", "name").agg(F.count("*").alias("n"))


@query(f"""WITH {PIECES_SQL}, d AS (SELECT doc_id, sum(n) AS chars, count(*) FILTER (regexp_matches(sentence, '[0-9]')) AS hits FROM o GROUP BY doc_id)
    SELECT doc_id, hits, round(1000.0 * hits / chars, 6) AS density, CASE WHEN 1000.0 * hits / chars < 0.4 THEN 'no-structure' ELSE 'structured' END AS verdict FROM d""")
def density_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segment.sentences(load(spark, sf_dir, "documents").select("doc_id", "text"))
    d = rows.groupBy("doc_id").agg(F.sum(F.length("sentence")).alias("chars"), F.count_if(F.col("sentence").rlike("[0-9]")).alias("hits"))
    density = F.lit(1000.0) * F.col("hits") / F.col("chars")
    return d.select("doc_id", "hits", F.round(density, 6).alias("density"), F.when(density < 0.4, "no-structure").otherwise("structured").alias("verdict"))


@query(r"""SELECT page_id, len(a) AS n_links, a[1] AS first_link, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title,
    length(trim(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS n_text
    FROM (SELECT page_id, html, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS a FROM pages)""")
def html_text_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace("html", r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]+>", " ")
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)
    return load(spark, sf_dir, "pages").select("page_id", F.size(links).cast("bigint").alias("n_links"), F.try_element_at(links, F.lit(1)).alias("first_link"), F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), F.length(F.trim(F.regexp_replace(bare, "[ \\t\\r\\n]+", " "))).cast("bigint").alias("n_text"))


@query("""WITH b AS (SELECT item_id, string_split(lower(text), ' ') AS w FROM benchmark),
    k AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM b)),
    d AS (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents),
    g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 7], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM d))
    SELECT doc_id, item_id, count(*) AS shared FROM g JOIN k USING (gram) GROUP BY ALL""")
def contamination_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of eight words that a document shares with a benchmark item."""

    hashed = F.transform(F.split(F.lower("text"), " "), lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        own = lambda i: [F.get(h, i + k) for k in range(8)]
        at = F.when(F.size(h) > 7, F.sequence(F.lit(0), F.size(h) - 8)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(F.xxhash64(*own(i)).alias("h"), F.xxhash64(F.lit("again"), *own(i)).alias("i")))

    marked = F.element_at(F.transform(F.array(hashed), windows), 1)
    grams = lambda table, key: load(spark, sf_dir, table).select(key, F.explode(marked).alias("g")).select(key, "g.h", "g.i")
    known = grams("benchmark", "item_id").distinct()
    # two hashes stand for a window of eight words, so that a document's words aren't repeated in each of its windows
    if known.count() <= 1_000_000:
        known = F.broadcast(known)
    shared = grams("documents", "doc_id").join(known, ["h", "i"]).distinct()  # what a document repeats counts once
    return shared.groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
