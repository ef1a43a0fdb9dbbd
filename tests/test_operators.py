import random
import time

import pytest
from pyspark.sql import functions as F

from strophe.functions import search
from strophe.functions import text as T
from strophe.operators import formula, graph, intervals, match, measure, outline, outlines, segment, sequences, tree
from strophe.sources import markup
from strophe.streaming import events


def values(spark, expr, rows, schema="x string, y string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_offsets_are_code_points(spark):
    assert values(spark, T.kept_positions(F.col("x")), [("𠀀, a.b", None), ("", None)]) == [[0, 3, 5], []]
    assert values(spark, T.hits(F.col("x"), F.col("y")), [("𠀀aaa", "aa"), ("x", ""), ("a", "aa")]) == [[1, 2], [], []]
    found = segment.sentences(spark.createDataFrame([(1, "𠀀a。 b！」c"), (2, ""), (3, None)], "doc_id long, text string"), terminators="。！？", closers="」")
    assert [(r.sent_no, r.char_start, r.char_end_excl) for r in found.orderBy("sent_no").collect()] == [(0, 0, 4), (1, 4, 7), (2, 7, 8)]


def test_numerals_round_trip(spark):
    rows = spark.range(1, 200).select("id", T.numeral(F.col("id")).alias("w"))
    assert rows.where(T.numeral_value(F.col("w")) != F.col("id")).count() == 0
    assert values(spark, T.numeral_value(F.col("x")), [("一十二", ""), ("百五", ""), ("", ""), ("二三", "")]) == [12, 105, None, None]


def test_label_similarity_and_subsequence(spark):
    pairs = [("ab", "ab"), ("abc", "ab"), ("abcdef", "a"), ("xay", "a"), ("abcdefgh", "cd"), ("axbyc", "abq"), ("", "ab"), ("", ""), ("b", "a"), ("a", "a")]
    wanted = [1, 0.9, 0.9, 0, 0.6, 2 / 3, 0, 0, 0, 1]
    assert values(spark, T.label_similarity(F.col("x"), F.col("y")), pairs) == pytest.approx(wanted)
    assert [T.similarity(x, y) for x, y in pairs] == pytest.approx(wanted)
    assert values(spark, T.subsequence(F.col("x"), F.col("y")), [("abc", "axbyc"), ("ca", "abc"), ("", "x"), ("x", "")]) == [True, False, False, False]


def test_staged_search_leaves_punctuation_out():
    assert search.staged("ab, cd ef gh", "bcd") == ("whole", 1, 6)
    assert search.staged("xx abyyyycyyd", "ab cd") == ("gapped", 3, 13)
    assert search.staged("abyyyyyyyc", "abc") is None and search.staged("axxb", "") is None
    assert search.staged("qq cdefg", "abcdefg") == ("suffix", 3, 8) and search.staged("abcde zz", "abcdexy") == ("prefix", 0, 5)
    assert search.staged("無量諸天發心", "無量等發心") == ("gapped", 0, 6)
    r = random.Random(4)
    for _ in range(200):
        hay, needle = ("".join(r.choice("abcd") for _ in range(n)) for n in (14, 4))
        first = None
        for s in range(len(hay)):
            if hay[s : s + 2] == needle[:2] and first is None:
                at = s + 2
                for c in needle[2:]:
                    k = hay.find(c, at, at + 7)
                    if k < 0:
                        break
                    at = k + 1
                else:
                    first = (s, at)
        found = search.loose(needle).search(hay)
        assert (found and found.span()) == first


def test_skeleton_takes_one_strictly_rising_place_a_leaf():
    from itertools import product

    r = random.Random(5)
    for _ in range(80):
        leaves = [[r.randrange(6) for _ in range(r.randrange(4))] for _ in range(5)]
        taken = match.skeleton(leaves)
        places = [x for x in taken if x is not None]
        assert all(a < b for a, b in zip(places, places[1:])) and all(x is None or x in own for x, own in zip(taken, leaves))
        chosen = ([x for x in choice if x is not None] for choice in product(*([None, *own] for own in leaves)))
        assert len(places) == max(len(c) for c in chosen if all(a < b for a, b in zip(c, c[1:])))


def test_balanced_windows_even_out(spark):
    text = "Word one. " * 20
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    sizes = lambda **k: [r.n_sentences for r in segment.chunked(docs, cap=6, budget=1000, **k).orderBy("chunk_no").collect()]
    assert sizes() == [6, 6, 6, 2] and sizes(balanced=True) == [5, 5, 5, 5]
    long = spark.createDataFrame([(1, "a" * 300 + ". b. " + "c" * 300 + ".")], "doc_id long, text string")
    assert [r.n_sentences for r in segment.chunked(long).orderBy("chunk_no").collect()] == [1, 1, 1]


def test_interval_joins_against_all_pairs(spark):
    r = random.Random(1)
    spans = [(g, i, s, s + r.randint(0, 900)) for i in range(40) for g in "ab" for s in [r.randint(0, 3000)]]
    points = [(r.choice("ab"), i, r.randint(0, 4000)) for i in range(60)]
    a = spark.createDataFrame(spans, "g string, k long, s long, e long")
    p = spark.createDataFrame(points, "g string, id long, at long")
    found = {(x.id, x.k) for x in intervals.contained(p, a, ["g"], "at", "s", "e", 100).collect()}
    assert found == {(i, k) for g, i, at in points for h, k, s, e in spans if g == h and s <= at < e}
    b = a.select("g", *(F.col(c).alias(f"{c}2") for c in "kse"))
    both = [(x.k, x.k2, x.g) for x in intervals.overlapping(a, b, ["g"], "s", "e", "s2", "e2", 100).collect()]
    assert sorted(both) == sorted((k, m, g) for g, k, s, e in spans for h, m, t, f in spans if g == h and s < f and t < e and s < e and t < f)
    near = {(x.k, x.id) for x in intervals.within_band(a, p, ["g"], "s", "at", 7).collect()}
    assert near == {(k, i) for g, k, s, _ in spans for h, i, at in points if g == h and abs(s - at) <= 7}


def test_as_of_takes_the_last_mark_and_the_last_tie(spark):
    marks = spark.createDataFrame([("a", 0, 0), ("a", 5, 1), ("a", 5, 2), ("b", 9, 3)], "g string, at long, n long")
    probes = spark.createDataFrame([("a", 4), ("a", 5), ("a", 99), ("b", 1)], "g string, x long")
    assert {(r.g, r.x): r.n for r in intervals.as_of(probes, marks, ["g"], "x", "at", ["n"], tie="n").collect()} == {("a", 4): 0, ("a", 5): 2, ("a", 99): 2, ("b", 1): None}


def test_levels_become_parents(spark):
    levels = [1, 2, 3, 2, 4, 1, 3]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(levels)], "doc long, i long, level long")
    found = {r.i: r.parent_at for r in tree.parents_of_levels(rows, ["doc"], "i", "level").collect()}
    assert found == {0: None, 1: 0, 2: 1, 3: 0, 4: 3, 5: None, 6: 5}


def test_pre_order_is_numeric_not_lexical(spark):
    nodes = [("t", "r", None, 0)] + [("t", f"k{i}", "r", i) for i in range(12)]
    found = tree.numbered(spark.createDataFrame(nodes, "tree string, id string, parent string, ord long"))
    assert [r.id for r in found.orderBy("order").collect()] == ["r"] + [f"k{i}" for i in range(12)]
    assert tree.subtree_sizes(found).where("id = 'r'").head().size == 13


def test_trees_match_themselves_and_survive_a_shift(spark):
    r = random.Random(3)
    nodes = [("t", "n0", None, 0, 0)]
    for i in range(1, 60):
        nodes.append(("t", f"n{i}", f"n{r.randrange(i)}", 3 * i, i))
    schema = "tree string, id string, parent string, line long, order long"
    gold = spark.createDataFrame(nodes, schema)
    score = lambda pred, t=0: match.tree_scores(pred, gold, t).head()
    assert score(gold).f == 1.0
    moved = gold.withColumn("line", F.col("line") + 1)
    assert score(moved).tp == 0 and score(moved).f == 0.0 and score(moved, 1).f == 1.0
    dropped = gold.where("id <> 'n59'")
    assert (score(dropped).p, score(dropped).fn) == (1.0, 1)


def test_alignment_against_all_choices():
    r = random.Random(2)
    for _ in range(60):
        n, m = r.randint(0, 4), r.randint(0, 4)
        near = {(i, j): (r.randint(0, 2), abs(i - j)) for i in range(n) for j in range(m) if r.random() < 0.5}

        def best(i: int, j: int):
            options = [(0, 0, 0)]
            for (a, b), (d, x) in near.items():
                if a >= i and b >= j:
                    k = best(a + 1, b + 1)
                    options.append((k[0] + 1, k[1] - d, k[2] - x))
            return max(options)

        pairs = match.align(near)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
        assert (len(pairs), -sum(near[p][0] for p in pairs), -sum(near[p][1] for p in pairs)) == best(0, 0)


def test_longest_chain():
    assert match.longest_chain([3, 1, 2, None, 2, 9, 4]) == [1, 2, 4, 6]
    assert match.longest_chain([]) == []


def test_scores_without_a_denominator_are_null(spark):
    empty = spark.createDataFrame([(0, 0, 0), (0, 1, 0)], "tp long, fp long, fn long")
    assert [tuple(r) for r in empty.select(*measure.precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))).collect()] == [(None, None, None), (0.0, None, 0.0)]


def test_families(spark):
    links = [("a1", "b1"), ("a2", "b1"), ("a2", "b2"), ("a9", "b9"), ("a3", "b2")]
    assert {r.id: r.family for r in graph.families(spark.createDataFrame(links, "a string, b string"), "a", "b").collect()} == {**dict.fromkeys(["a1", "a2", "a3", "b1", "b2"], "a1"), "a9": "a9", "b9": "a9"}


TEXT = "此經分為三段。一序分、二正宗分、三流通分。初序分者，如是我聞。序分有二。一通序、二別序。一通序者，明證信。二別序者，明發起。別序竟。二正宗分者，明所說。三流通分者，明勸信。"


def test_announced_divisions_become_a_tree(spark):
    nodes = formula.build(formula.scan(TEXT, formula.CJK))
    assert [(n["level"], n["heading"]) for n in nodes] == [(1, "序分"), (1, "正宗分"), (1, "流通分"), (2, "通序"), (2, "別序")]
    assert all(TEXT[n["char_start"]:].startswith(tuple("初一二三")) for n in nodes)
    docs = spark.createDataFrame([(1, TEXT), (2, ""), (3, None)], "doc_id long, text string")
    assert formula.outlines_of(docs, formula.CJK).count() == 5
    assert formula.statements_of(docs, formula.CJK).where("kind = 'announce'").count() == 2


def test_a_list_that_nothing_takes_up_is_no_division():
    statements = formula.scan("佛有三身。又說餘事。", formula.CJK)
    assert statements and formula.build(statements) == []


XML = b"""<TEI xmlns:cb="x"><teiHeader><title>T</title><charDecl><char xml:id="C1"><mapping type="unicode">U+20000</mapping></char></charDecl></teiHeader>
<text><lb n="0001a01" ed="T"/><cb:mulu level="1" type="x">M</cb:mulu>ab<g ref="#C1"/><note>in</note>c
<lb n="x" ed="X"/>d<lb n="0001a02" ed="T"/><lg><l>e<caesura/>f</l></lg><g ref="#C2"/></text></TEI>"""


def test_lines_keep_mixed_content_in_order(spark):
    lines = markup.parse_lines(XML, "T")
    assert [x["text"] for x in lines] == ["ab\U00020000cd", "ef[#C2]"]
    assert lines[0]["notes"] == [{"offset": 3, "text": "in"}] and lines[0]["marks"] == [{"offset": 0, "level": 1, "text": "M"}] and lines[0]["n_alt"] == 1 and lines[1]["caesuras"] == [1]
    files = spark.createDataFrame([("a", XML), ("b", b"<broken")], "text_id string, content binary")
    found, errors = markup.read_lines(files, "T")
    assert found.count() == 2 and [r.text_id for r in errors.collect()] == ["b"]
    assert sorted(r.kind for r in markup.elements_of(found).collect()) == ["caesura", "mulu", "note"]


def test_outline_rows_and_torn_records(spark, tmp_path):
    (tmp_path / "o.txt").write_text("A1 Whole (2)\n  B1 First\n  B2-4 Rest（3）\n")
    found = markup.read_outline(spark, str(tmp_path / "o.txt")).orderBy("lineno").collect()
    assert [(r.level, r.label, r.heading, r["count"]) for r in found] == [(1, "A1", "Whole", 2), (2, "B1", "First", None), (2, "B2-4", "Rest", 3)]
    (tmp_path / "r.jsonl").write_text('{"k": "a", "n": 1}\n{"k": "a", "n": 2}\n{"k": "b"')
    records = markup.read_records(spark, str(tmp_path / "r.jsonl"), "k string, n long")
    assert [(r.k, r.n) for r in markup.latest(records, "k", ["n"]).collect()] == [("a", 2)]


def test_streams_give_the_batch_rows(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", i % 2, "xy"[i % 2], float(i)) for i in range(50)]
    batch = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double").select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type", "value")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))

    def run(df, mode: str, name: str):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return sorted(map(tuple, spark.table(name).collect()))

    windows = lambda df: events.windowed(df, wide="10 minutes")
    assert run(windows(stream), "complete", "w") == sorted(map(tuple, windows(batch).collect()))
    last = lambda df: events.last_of_key(df, "user_id", "event_id", "value")
    assert run(last(stream), "complete", "l") == sorted(map(tuple, last(batch).collect())) == [(0, 48, 48.0), (1, 49, 49.0)]
    assert run(events.running_budget(stream, "user_id", "value", 600.0), "update", "b") == [(0, 600.0, False), (1, 625.0, True)]
    assert len(run(events.once(stream, ["event_type"]), "append", "o")) == 2


def test_trees_deeper_than_the_bound_are_an_error(spark):
    nodes = spark.createDataFrame([(1, i, i - 1 if i > 1 else None, 1) for i in range(1, 5)], "tree long, id long, parent long, ord int")
    walk = lambda most: tree.walked(nodes, F.lit(1), lambda above: above + 1, most)
    assert walk(4).count() == 4
    with pytest.raises(ValueError):
        walk(3)


def test_components_of_chains_stars_and_loops(spark):
    r = random.Random(1)
    links = [(f"a{i:02}", f"a{i + 1:02}") for i in range(40)] + [("b00", f"b{i:02}") for i in range(1, 20)] + [("c", "c"), (None, "d")]
    links = [(x, y) if r.random() < 0.5 else (y, x) for x, y in links]
    found = {x.id: x.component for x in graph.components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert found == {**{f"a{i:02}": "a00" for i in range(41)}, **{f"b{i:02}": "b00" for i in range(20)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_spans_of_nodes_with_deep_or_unplaced_children(spark):
    nodes = [("t", "r", None, 0, 0), ("t", "x", "r", 1, None), ("t", "y", "x", 2, 5), ("t", "z", "r", 3, 3), ("t", "w", "r", 4, 9)]
    rows = spark.createDataFrame(nodes, "tree string, id string, parent string, order long, at long")
    found = {x.node: (x.kind, x.char_start, x.char_end_excl) for x in outline.outlined(rows, spark.createDataFrame([("t", 12)], "tree string, total long")).collect()}
    assert found == {"r": ("preamble", 0, 5), "y": ("leaf", 5, 9), "w": ("leaf", 9, 12)}


def test_repair_goes_on_with_what_it_has_repaired(spark):
    nodes = [("t", "r", None, 0, 10, 20), ("t", "a", "r", 1, 5, 40), ("t", "b", "a", 2, 1, 35), ("t", "c", "r", 3, 18, 19), ("t", "d", "r", 4, 12, 13)]
    rows = spark.createDataFrame(nodes, "tree string, id string, parent string, order long, start long, end long")
    found = {x.id: (x.start, x.end, x.repair) for x in outline.repaired(rows).collect()}
    assert found["r"] == (10, 20, None) and found["a"] == (10, 20, "clipped") and found["b"] == (10, 20, "clipped")
    assert {found["c"], found["d"]} == {(18, 19, None), (None, None, "demoted")} or {found["c"], found["d"]} == {(None, None, "demoted"), (12, 13, None)}


def test_an_item_that_announces_takes_the_next_ones(spark):
    items = [("t", 1, False, 2), ("t", 2, True, 2), ("t", 3, True, None), ("t", 4, True, None), ("t", 5, True, None), ("t", 6, True, None), ("t", 7, False, None)]
    rows = spark.createDataFrame(items, "tree string, ord long, ordinal boolean, count long")
    assert {x.ord: x.parent for x in sequences.chart_parents(rows, ["tree"], "ord").collect()} == {1: None, 2: 1, 3: 2, 4: 2, 5: 1, 6: None}


def test_repeated_rows_keep_their_split(spark):
    spans = spark.createDataFrame([("a", 0, 0, 5), ("b", 1, 3, None)], "split string, ord int, start_incl long, end_excl long")
    points = spark.createDataFrame([(1,), (1,), (4,), (7,), (-1,), (None,)], "pos long")
    assert sorted((x.pos is None, x.pos or 0, x.split) for x in intervals.spans_of(points, spans, [], "pos", "none").collect()) == [(False, -1, "none"), (False, 1, "a"), (False, 1, "a"), (False, 4, "a"), (False, 7, "b"), (True, 0, "none")]


def test_tiles_and_ranks_count_equal_values(spark):
    r = random.Random(8)
    rows = [(k, r.randrange(6)) for k in "ab" for _ in range(r.randint(5, 40))]
    df = spark.createDataFrame(rows, "k string, v long")
    found = {(x.k, x.tile): (x.n, x.total) for x in measure.tiles_of(df, "v", ["k"], 10).collect()}
    for k in "ab":
        own = sorted(v for j, v in rows if j == k)
        tiles: dict = {}
        for i, v in enumerate(own):
            tiles.setdefault(i * 10 // len(own), []).append(v)
        assert {t: (len(x), sum(x)) for t, x in tiles.items()} == {t: x for (j, t), x in found.items() if j == k}


def test_minted_ids_are_version_five(spark):
    import uuid

    from strophe.plans.details import uuid5

    names = ["", "a", "https://example.org/x", "漢字 é"]
    found = spark.createDataFrame([(n,) for n in names], "n string").select("n", uuid5(F.col("n")).alias("u")).collect()
    assert {r.n: r.u for r in found} == {n: str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names}


def test_quotations_nest_and_split(spark):
    from strophe.functions import quotes

    assert quotes.quotations("「a『b』」」「c") == [(0, 6, 1), (2, 5, 2)]
    assert quotes.quotations(None) == [] and quotes.pieces("a、「b、c」、、d", "、") == [(0, 1), (2, 7), (9, 10)]


def test_what_follows_in_a_large_family_takes_linear_time(spark):
    n, began = 100_000, time.time()
    kids = spark.range(1, n + 1).selectExpr("'t' tree", "id", "CAST(0 AS BIGINT) parent", "id ord", "CASE WHEN id % 3 <> 0 THEN id * 10 END start", "CASE WHEN id % 3 = 1 THEN id * 10 + 4 END end")
    root = spark.range(1).selectExpr("'t' tree", "id", "CAST(NULL AS BIGINT) parent", "id ord", "CAST(0 AS BIGINT) start", "CAST(2000000 AS BIGINT) end")
    found = outlines.admissible(kids.union(root), 5_000_000).where("id % 3 = 0 AND id > 0 OR id = 100000").orderBy("id").collect()
    assert [(x.lo, x.hi) for x in found] == [(k * 10 - 10, k * 10 + 10) if k < n else (n * 10 - 20, 2_000_000) for k in [*range(3, n, 3), n]]
    ends = sequences.unit_ends(kids.selectExpr("tree", "id", "id % 2 AS level"), ["tree"], "id", "level", F.lit(n)).orderBy("id").collect()
    assert [x.end_at for x in ends] == [min(k + 1, n) if k % 2 == 0 else k if k < n else n for k in range(1, n + 1)]
    assert time.time() - began < 60


def test_anchored_rules_find_what_a_plain_search_does():
    r = random.Random(3)
    parts = {"CJK": ["分為", "大分", "略有", "有", "二", "三", "十", "段", "。", "，", "一", "、", "初", "第", "者", "中", "已竟", "竟", "訖", "\n", "甲", "甲乙丙丁戊己庚辛壬癸"], "LATIN": ["has", "have", " in", " ", "two ", "three ", "parts", "kinds", ":", " first, ", "a", "; ", "First ", "This ends ", ". ", "\n", "x" * 15, "3 points"]}
    for name, words in parts.items():
        for rule in getattr(formula, name):
            for _ in range(400):
                text = "".join(r.choices(words, k=r.randint(0, 60)))
                assert [m.span() for m in formula.matches(rule, text)] == [m.span() for m in formula.re.finditer(rule.pattern, text)], (rule.name, text)


def test_scanning_tries_no_start_far_from_an_anchor():
    text = "丙" * 3_000_000 + "文分為二段。"
    began = time.time()
    assert [(s["kind"], s["char_start"]) for s in formula.scan(text, formula.CJK)] == [("announce", 2_999_989)]
    assert time.time() - began < 2


def test_texts_made_of_small_rows_are_spread(spark, tmp_path):
    from strophe.plans import labels

    spark.range(1000).selectExpr("id AS p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("outline_build", "genre_gate", "statement_scan"):
        assert "RoundRobin" not in (plan := labels.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString())
        assert plan.rindex("MapInArrow") < plan.rindex("REPARTITION_BY_NUM")


def test_chains_of_small_trees_take_no_walk_and_others_are_the_same(spark, monkeypatch):
    r = random.Random(5)
    rows = [(f"t{k}", f"n{i}", None if i == 0 or r.random() < 0.05 else f"n{r.randint(max(0, i - 2), i - 1)}") for k in range(40) for i in range(r.randint(1, 7))]
    rows += [("loop", "a", "b"), ("loop", "b", "a"), ("loop", "r", None), ("orphan", "x", "y"), ("orphan", "r", None), ("orphan", "s", "r")]
    odd = [(None, "a", None), (None, "b", "a"), ("null", None, None), ("null", "c", None), ("twice", "a", None), ("twice", "b", "a"), ("twice", "b", "a"), ("twice", "c", "b")]
    frame = lambda x: spark.createDataFrame(x, "tree string, id string, parent string")
    key = lambda df: sorted(map(str, df.collect()))
    wanted, wanted_odd = key(outlines.walked_chains(frame(rows))), key(outlines.walked_chains(frame(rows + odd)))
    assert key(outlines.single_chains(frame(rows + odd))) == wanted_odd
    monkeypatch.setattr(outlines, "WHOLE", 4)
    assert key(outlines.single_chains(frame(rows + odd))) == wanted_odd
    monkeypatch.setattr(outlines, "WHOLE", 10_000)
    monkeypatch.setattr(outlines, "DEEPEST", 7)
    deep = [("d", i, i - 1 if i > 1 else None) for i in range(1, 9)]
    with pytest.raises(ValueError):
        outlines.single_chains(spark.createDataFrame(deep, "tree string, id long, parent long"))
    monkeypatch.setattr(tree, "table", None)
    assert key(outlines.single_chains(frame(rows))) == wanted
    assert outlines.single_chains(spark.createDataFrame(deep[:7], "tree string, id long, parent long")).head().length == 7


def test_line_records_of_many_files_share_batches(spark):
    files = spark.range(3000).selectExpr("CAST(id AS STRING) text_id", "CASE WHEN id % 1000 = 7 THEN NULL ELSE encode(concat('<TEI><text><lb n=\"1\"/>a', id, '<lb n=\"2\"/></text></TEI>'), 'UTF-8') END content").coalesce(1)
    found, errors = markup.read_lines(files)
    assert sorted(r.text_id for r in errors.collect()) == ["1007", "2007", "7"]
    rows = found.orderBy(F.col("text_id").cast("int"), "line_no").select("text_id", "line_no", "linehead", "text").collect()
    assert [tuple(r) for r in rows] == [x for i in range(3000) if i % 1000 != 7 for x in ((str(i), 0, "1", f"a{i}"), (str(i), 1, "2", ""))]


def test_documents_are_spread_before_markup(spark, tmp_path):
    from strophe.plans import structures

    spark.range(50).selectExpr("id AS doc_id", "'a' AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    plan = structures.tei_lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("MapInArrow") < plan.rindex("REPARTITION_BY_NUM")


def test_first_bare_hit_is_where_the_kept_characters_stand(spark):
    r = random.Random(7)
    texts = [("".join(r.choices("nnt.. ,a\n𠀀", k=r.randint(0, 12))), None) for _ in range(300)] + [(None, None), ("n" + " ." * 20_000 + "t", None)]
    for needle in ("nt", "n", "t𠀀n", "a.", ""):
        keep, hit = T.kept_positions(F.col("x")), F.try_element_at(T.hits(T.strip_punct(F.col("x")), F.lit(needle)), F.lit(1))
        wanted = [None if k is None or h is None else (k[h], k[h + len(needle) - 1] + 1) for k, h in zip(values(spark, keep, texts), values(spark, hit, texts))]
        assert [p and tuple(p) for p in values(spark, T.first_bare_hit(F.col("x"), needle), texts)] == wanted
