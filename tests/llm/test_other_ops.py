import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strophe.llm import gru, lm_score, multi_index, quality, warc
from strophe.llm.ann import Hash, nearest
from strophe.llm.components import components
from strophe.llm.lm_score import score_documents
from strophe.llm.mixing import mix
from strophe.llm.multi_index import near_vectors

VECTORS = "vec_id long, embedding array<float>, label int"


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 120)] + [(7, 7), (200, 199)]
    r = random.Random(1)
    links = [(a, b) if r.random() < 0.5 else (b, a) for a, b in links]
    found = {x.id: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 120)}, 199: 199, 200: 199}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def cloud(n: int, d: int = 16, seed: int = 0) -> list:
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, d))
    for k in range(0, n, 3):
        x[k] = x[k // 2] + 0.1 * r.standard_normal(d)
    return [(i, [float(v) for v in row], 0) for i, row in enumerate(x.astype(np.float32))]


ODD_VECTORS = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [1.0] * 15 + [None], 1), (9004, [float("nan")] * 16, 1), (9005, [float("inf")] + [1.0] * 15, None), (9006, [1.0], 1)]


def test_near_vectors_against_brute_force(spark):
    rows = cloud(200) + [(500, cloud(1)[0][1], 0), (501, [2 * v for v in cloud(1)[0][1]], 0)] + ODD_VECTORS + [(500, cloud(1)[0][1], 0), (None, [1.0] * 16, 0)]
    found = near_vectors(spark.createDataFrame(rows, VECTORS).withColumn("n_links", F.lit(1)), recall=1.0).collect()
    assert len(found) == len(rows)
    by = {r.vec_id: r for r in found}
    ids = [i for i, *_ in rows[:202]]
    x = np.array([v for _, v, _ in rows[:202]], dtype=float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.array(ids)
    for _ in ids:
        label = np.minimum(label, np.where(near, label[None, :], 10**9).min(axis=1))
    assert [by[i].n_links for i in ids] == near.sum(axis=1).tolist()
    assert [by[i].component_id for i in ids] == label.tolist()
    assert all(by[i].n_links == 0 and by[i].component_id == i and by[i].kept for i, *_ in ODD_VECTORS)
    assert near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_links_near_a_subspace_are_found(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((6000, 4)) @ np.linalg.qr(r.standard_normal((64, 4)))[0].T + 0.01 * r.standard_normal((6000, 64))
    x = x.astype(np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    real = int((u @ u.T >= 0.9).sum()) - len(x)
    rows = [(i, row, 0) for i, row in enumerate(x.tolist())]
    found = near_vectors(spark.createDataFrame(rows, VECTORS)).agg(F.sum("n_links")).head()[0]
    assert 0.97 * real <= found <= real, found / real


def test_traversal_visits_the_nearest_cells_in_order():
    r = np.random.default_rng(3)
    a, b = r.random((5, 6)), r.random((5, 7))
    for row, cells in zip(range(5), multi_index.traversal(a, b, 20)):
        sums = (a[row][:, None] + b[row][None, :]).ravel()
        assert np.allclose(sums[cells], np.sort(sums)[:20])


def test_hot_cells_are_met_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("strophe.llm.grid.BLOCK", 8)
    base = np.random.default_rng(1).standard_normal(16)
    rows = [(i, [float(v) for v in base + 0.01 * i * np.eye(16)[i % 16]], 0) for i in range(40)]
    found = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame(rows, VECTORS)).collect()}
    assert found == {i: 39 for i in range(40)}


def test_rotations_keep_lengths_and_axes_are_nearest():
    h, x = Hash.make(10), np.random.default_rng(0).standard_normal((20, 10))
    y = h.rotated(x, 1, 0)
    assert np.allclose((y * y).sum(axis=1), (x * x).sum(axis=1))
    gaps = h.gaps(x, 1, 0)
    assert (gaps.argmin(axis=1) == h.axes(x, 1, 0)).all() and (gaps.min(axis=1) == 0).all()
    cell = h.part(h.axes(x, 1, 0)) * h.parts + h.part(h.axes(x, 1, 1))
    assert h._replace(depth=0.0).visited(x, 1)[np.arange(20), cell].all() and h._replace(depth=0.0).visited(x, 1).sum() == 20


def test_nearest_against_brute_force(spark):
    rows = cloud(300, seed=2) + [(400, cloud(300, seed=2)[20][1], 0)] + ODD_VECTORS
    df = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit(0.0))
    found: dict = {}
    for r in nearest(df, df.where("vec_id % 20 = 0"), 5, recall=1.0).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    fine = [(i, np.array(v, dtype=float)) for i, v, _ in rows[:301]]
    for q, v in fine:
        if q % 20:
            continue
        best = sorted(((-float(v @ w), i) for i, w in fine if i != q))[:5]
        assert [x[1] for x in sorted(found.pop(q))] == [i for _, i in best]
    assert not found
    few = df.where("vec_id < 3")
    assert sorted((r.query_id, r.rank) for r in nearest(few, few.where("vec_id = 0"), 5).collect()) == [(0, 1), (0, 2)]
    assert nearest(df.limit(0), df, 5).count() == 0


def test_tables_alone_have_the_recall_asked_for(spark):
    r = np.random.default_rng(8)
    x = r.standard_normal((50_000, 32)).astype(np.float32)
    x[::2] += 1.5 * r.standard_normal((50, 32)).astype(np.float32)[r.integers(0, 50, 25_000)]
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": pa.array(list(x), pa.list_(pa.float32()))})).repartition(4)
    found: dict = {}
    for q, v in nearest(df, df.where("vec_id % 100 = 0"), 20).select("query_id", "vec_id").collect():
        found.setdefault(q, set()).add(v)
    x, hit = x.astype(float), 0
    for q in range(0, len(x), 100):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(found[q] & set(np.argpartition(-s, 20)[:20].tolist()))
    assert hit >= 0.9 * 500 * 20, hit


def test_ties_and_lengths_of_vectors(spark):
    rows = [(i, [1.0, 2.0], 0) for i in range(30)] + [(100 + i, [3.0, 1.0, float(i)], 0) for i in range(3)] + [(40, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows, VECTORS)
    found = sorted((r.query_id, r.rank, r.vec_id) for r in nearest(df, df.where("vec_id IN (0, 100)"), 4).collect())
    assert found == [(0, 1, 40), (0, 2, 1), (0, 3, 2), (0, 4, 3), (100, 1, 101), (100, 2, 102)]
    links = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df).collect()}
    assert all(links[i] == (30, 0) for i in [*range(30), 40]) and [links[100 + i] for i in range(3)] == [(1, 100), (2, 100), (1, 100)]


def test_recurrent_gradients():
    r = np.random.default_rng(0)
    m = gru.new(np.array([5, 9, 4, 3, 2, 2, 1.0]), 5, 4)
    m = m._replace(**{p: getattr(m, p).astype(float) for p in gru.PARAMETERS})
    before, target, fresh = r.integers(0, 7, (6, 3)), r.integers(0, 7, (6, 3)), r.random((6, 3)) < 0.2
    grads = gru.window(m, np.zeros((3, 5)), before, target, fresh)[2]
    for p in gru.PARAMETERS:
        a = getattr(m, p)
        at = tuple(r.integers(0, s) for s in a.shape)
        a[at] += 1e-5
        up = gru.window(m, np.zeros((3, 5)), before, target, fresh)[0]
        a[at] -= 2e-5
        down = gru.window(m, np.zeros((3, 5)), before, target, fresh)[0]
        a[at] += 1e-5
        assert grads[p][at] == pytest.approx((down - up) / 2e-5, abs=1e-6)


def test_scores_don_t_depend_on_windows_and_sum_to_one():
    m = gru.new(np.array([5, 9, 4, 3, 2, 2, 1.0]), 4, 3)
    docs = [np.array([3, 2, 5, 0]), np.array([0]), np.array([6] * 70 + [0])]
    one = gru.Scorer(m, together=1, steps=5).score(docs)
    assert np.allclose(one, gru.Scorer(m, together=9, steps=64).score(docs), atol=1e-4)
    assert np.allclose(one, gru.Scorer(m, together=2, tokens=5).score(docs), atol=1e-4)
    assert sum(math.exp(gru.output(m, np.zeros((1, 4), np.float32), np.array([w]))[0]) for w in range(7)) == pytest.approx(1, abs=1e-5)


def test_language_model_counts_and_held_out_gain(spark, monkeypatch):
    monkeypatch.setattr("strophe.llm.lm_score.WORDS", 12)
    monkeypatch.setattr("strophe.llm.lm_score.HEAD", 20)
    r = random.Random(3)
    docs = [(i, " ".join(r.choice(["the Cat", "sat on", "a mat", f"w{r.randrange(60)}"]) for _ in range(30))) for i in range(80)] + [(1000, None), (1001, ""), (None, "the cat"), (7, "the cat")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS word", "1 AS n")
    found = score_documents(rows).collect()
    assert len(found) == len(docs)
    split = lambda t: (t or "").lower().split() + [None]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in docs if not out(i) for w in split(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter((i, out(i), len(split(t)), sum(counts[w] > 0 for w in split(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in split(t)), 6)) for i, t in docs)
    assert Counter((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in found) == want
    held = [x for x in found if x.held_out]
    assert sum(x.score for x in held) > sum(x.base_score for x in held)
    assert score_documents(rows.limit(0)).count() == 0


def test_recurrent_model_learns_from_documents_outside_its_first_sample(spark, monkeypatch):
    monkeypatch.setattr("strophe.llm.lm_score.SAMPLE_DOCUMENTS", 4)
    ids = spark.range(120).withColumn("held", F.crc32(F.col("id").cast("string").cast("binary")) % 7 == 2).orderBy(F.xxhash64("id")).collect()
    first = [r.id for r in ids if not r.held][:4]
    docs = [(r.id, " ".join(["d c b a" if r.id in first else "a b c d"] * 100)) for r in ids]
    held = [x for x in score_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(2)).collect() if x.held_out]
    assert sum(x.score - x.base_score for x in held) > 0.3 * sum(x.n_tokens for x in held)


def plain_score(m: gru.Model, words: list) -> float:
    """Natural log-probability of a document, word by word in doubles, from the model's own definition."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    k, h, before, total = m.wh.shape[0], np.zeros(m.wh.shape[0]), gru.END, 0.0
    for w in words:
        a, b = m.embed[before].astype(float) @ m.wi + m.bi, h @ m.wh.astype(float)
        r, z = sig(a[:k] + b[:k]), sig(a[k : 2 * k] + b[k : 2 * k])
        n = np.tanh(a[2 * k :] + r * b[2 * k :])
        h = (1 - z) * n + z * h
        c = int(m.cls[w])
        classes = h @ m.uc + m.bc
        inside = m.uw[m.first[c] : m.first[c + 1]] @ h + m.bw[m.first[c] : m.first[c + 1]]
        inside = inside if m.first[c + 1] - m.first[c] > 1 else np.zeros(1)
        total += classes[c] - np.log(np.exp(classes).sum()) + inside[w - m.first[c]] - np.log(np.exp(inside).sum())
        before = w
    return float(total)


def test_scores_against_a_plain_model(spark, monkeypatch):
    monkeypatch.setattr("strophe.llm.lm_score.WORDS", 8)
    monkeypatch.setattr("strophe.llm.lm_score.HEAD", 12)
    kept, fitted = {}, lm_score.fitted
    monkeypatch.setattr(lm_score, "fitted", lambda training, numbers, model: kept.setdefault("all", (fitted(training, numbers, model), numbers))[0])
    r = random.Random(3)
    docs = [(i, " ".join(r.choice(["the Cat", "sat on", "a mat", f"w{r.randrange(30)}"]) for _ in range(1 + i % 40))) for i in range(60)] + [(99, None), (98, "long " * 3000 + "end")]
    found = {x.doc_id: x.score for x in score_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    model, numbers = kept["all"]
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in docs if not out(i) for w in (t or "").lower().encode().split())
    beyond, kinds = sum(n for w, n in counts.items() if w not in numbers), sum(w not in numbers for w in counts)
    for i, t in docs:
        words = (t or "").lower().encode().split()
        want = plain_score(model, [numbers.get(w, gru.OTHER) for w in words] + [gru.END]) / math.log(10)
        want += sum(math.log10((counts[w] + 1) / (beyond + kinds + 1)) for w in words if w not in numbers)
        assert found[i] == pytest.approx(want, rel=2e-4, abs=1e-3), i


def test_every_word_is_trained_on_and_chunks_share_moments(monkeypatch):
    seen = Counter()
    window = gru.window
    monkeypatch.setattr(gru, "window", lambda m, h, before, target, fresh: seen.update(target.ravel().tolist()) or window(m, h, before, target, fresh))
    docs = [np.array([2, 3, 4, 0])] * 50 + [np.array([5, 6, 0])]
    assert gru.train_all(gru.new(np.ones(7), 4, 3), docs, 0.01, streams=16, tokens=100) == 203
    want = Counter(w for d in docs for w in d.tolist())
    assert all(seen[w] >= want[w] for w in want) and sum(seen.values()) < 203 + 3 * 16


def test_arc_versions_and_conversion():
    for version in (1, 2):
        payloads = [b"", b"<p>\n\nfiledesc:\r\n\r\n</p>", "é漢".encode()]
        data = warc.arc_start(version) + b"".join(warc.arc_header(version, "http://x.org/a%20b", "text/html", len(p), i) + p + b"\n" for i, p in enumerate(payloads))
        found = [warc.converted(*r) for r in warc.parse_arc(data)]
        assert [f[0] for f in found] == [0, 1, 2] and [f[4] for f in found] == payloads
        assert found[0][2] == "2000-01-01T00:00:00Z" and found[1][1] == "http://x.org/a%20b" and found[1][6] == hashlib.sha256(payloads[1]).hexdigest()
        with pytest.raises(warc.ArcError):
            list(warc.parse_arc(data[:-5]))
    old = b"filedesc://a 0.0.0.0 19970101000000 text/plain 24\n1 0 X\nURL IP-address..\n\n" + b"http://x.org/two words 1.2.3.4 19970203040506 text/html 2\nhi\n"
    assert [(h["URL"], p) for h, p in warc.parse_arc(old)] == [("http://x.org/two words", b"hi")]


def test_pages_come_back_from_the_archives(spark):
    long = "<p>" + "x" * 200 + "</p>"
    pages = [(4, "http://a.org/4", long), (2, "http://a.org/2?x y", long), (9, None, long), (5, "u", None), (6, "u", ""), (7, "u", "short"), (8, "u", "short"), (1, "u", "a\r\n\r\nWARC/1.1\r\né" + "y" * 120), (3, "u", "漢" * 33), (10, "u", "漢" * 34), (11, "u", "漢" * 34), (None, "u", long)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    found = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(rows).collect()}
    first = {long: 2, "漢" * 34: 10}
    for page, _, html in pages:
        body = (html or "").encode()
        lead = first.get(html)
        again = lead is not None and lead != page
        assert found[page] == (len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", lead if again else None), page
    assert warc.archive_pages(rows.limit(0)).count() == 0


def test_records_repeated_in_full_share_a_type(spark):
    rows = spark.createDataFrame([(1, "u", "z" * 150)] * 2 + [(2, "u", "z" * 150)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.archive_pages(rows).collect()) == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]


def documents(spark, sizes: dict):
    rows = [(1000 * k + i, "w " * (1 + i % 5), "en", s, 0) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_mixture_meets_entropy_and_takes_all(spark):
    docs = documents(spark, {"a": 400, "b": 40, "c": 40})
    found = mix(docs, entropy=0.9, repeats=50.0).toPandas()
    assert found["doc_id"].nunique() == 480
    weights = found.groupby("source")["weight"].first()
    h = -(weights * np.log(weights)).sum() / np.log(3)
    assert h == pytest.approx(0.9, abs=0.002)
    shares = found.groupby("source")["tokens"].sum() / found["tokens"].sum()
    assert np.allclose(shares[weights.index], weights, atol=0.02)
    early = found[found["block"] < 32].groupby("source")["tokens"].sum()
    assert np.allclose((early / early.sum())[weights.index], weights, atol=0.08)


def test_mixture_keeps_the_repetition_limit_and_budget(spark):
    docs = documents(spark, {"a": 400, "b": 40})
    found = mix(docs, entropy=1.0, repeats=2.0).toPandas()
    assert found.groupby("doc_id").size().max() <= 2 and found[found["source"] == "b"].groupby("doc_id").size().mean() > 1.9
    small = mix(docs, entropy=0.5, repeats=1.0, budget=300).toPandas()
    assert 0.9 * 300 <= small["tokens"].sum() <= 300 and small.groupby("doc_id").size().max() == 1


def test_mixture_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, None, None, 0), (None, "a b", "en", "x", 1), (2, "", "en", "x", 1), (2, "", "en", "x", 1), (3, "c", None, None, 2)], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "9 AS tokens", "8 AS s", "7 AS epoch")
    found = mix(rows, keep=rows.columns)
    assert {(r.doc_id, r.text, r.tokens, r.epoch) for r in found.collect()} >= {(1, None, 9, 7), (None, "a b", 9, 7), (2, "", 9, 7), (3, "c", 9, 7)}
    assert mix(rows.limit(0)).count() == 0


def test_quality_shrinks_sparse_sites(spark):
    rows = [(i, "good", "p", 0.9) for i in range(200)] + [(500 + i, "bad", "p", 0.2) for i in range(200)] + [(900, "one", None, 0.5), (901, None, "q", 0.5)]
    found = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, host string, path string, p_doc double"), 0.5).collect()}
    mean = sum(r[3] for r in rows) / len(rows)
    assert found[0].host_rate > 0.85 and found[500].host_rate < 0.25 and abs(found[900].host_rate - mean) < 0.05
    assert found[0].quality > 0.9 > found[900].quality > found[500].quality


def plain_posteriors(rows: list, prior: float) -> dict:
    """quality.judged() by loops over all other documents of a site."""
    rows = [(i, h or "", p or "", e) for i, h, p, e in rows]
    mean = sum(r[3] for r in rows) / len(rows)

    def pseudo(groups: list) -> float:
        groups = [g for g in groups if g[1] > 1]
        n = sum(g[1] for g in groups)
        if not n:
            return 2.0
        chance, between = sum(c * (1 - c) for *_, c in groups) / n, sum(k * (s / k - c) ** 2 for s, k, c in groups) / n
        return min(10_000.0, max(2.0, mean * (1 - mean) / max(between - chance, mean * (1 - mean) / 10_000) - 1))

    def sums(at: slice) -> dict:
        found: dict = {}
        for r in rows:
            found.setdefault(r[at], []).append(r[3])
        return found

    hosts, paths = sums(slice(1, 2)), sums(slice(1, 3))
    strong = pseudo([(sum(v), len(v), mean) for v in hosts.values()])
    centre = {k: (sum(v) + strong * mean) / (len(v) + strong) for k, v in hosts.items()}
    firm = pseudo([(sum(v), len(v), centre[k[:1]]) for k, v in paths.items()])
    odds = lambda p: math.log(p / (1 - p))
    bounded = lambda p: min(1 - 1e-6, max(1e-6, p))
    found = {}
    for i, h, p, e in rows:
        host = (sum(hosts[(h,)]) - e + strong * mean) / (len(hosts[(h,)]) - 1 + strong)
        path = (sum(paths[(h, p)]) - e + firm * host) / (len(paths[(h, p)]) - 1 + firm)
        found[i] = (host, path, 1 / (1 + math.exp(-(odds(bounded(path)) + odds(bounded(e)) - odds(prior)))))
    return found


def test_quality_posteriors_against_plain_loops(spark):
    r = random.Random(12)
    rows = [(i, r.choice(["a", "b", "c", None]), r.choice(["x", "y", None]), round(r.random() ** (1 + i % 3), 3)) for i in range(150)] + [(900, "alone", "x", 0.7)]
    found = quality.judged(spark.createDataFrame(rows, "doc_id long, host string, path string, p_doc double"), 0.4).collect()
    want = plain_posteriors(rows, 0.4)
    assert len(found) == len(rows)
    for x in found:
        assert (x.host_rate, x.path_rate, x.quality) == pytest.approx(want[x.doc_id], abs=1e-9) and x.keep == (x.quality >= 0.5)


def test_quality_learns_and_handles_odd_rows(spark):
    r = random.Random(6)
    good = [(i, " ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(r.randrange(50)) for _ in range(40)) + ".", "en", f"s{i % 3}") for i in range(60)]
    bad = [(100 + i, "BUY!!! NOW!!! $$$ " * 20, "en", "s9") for i in range(30)]
    rows = spark.createDataFrame(good + bad + [(500, None, None, None), (501, "", "en", "s1"), (None, "plain words here", "en", "s1")], "doc_id long, text string, lang string, source string").selectExpr("*", "'x' AS host", "1 AS keep")
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i in [*range(0, 60, 2), *range(100, 130, 2)]] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    found = {x.doc_id: x for x in quality.rated(rows, labels).collect()}
    assert all(found[i].keep for i, *_ in good) and not any(found[i].keep for i, *_ in bad) and {500, 501, None} <= set(found)
    assert quality.rated(rows.limit(0), labels).count() == 0
    assert quality.rated(rows, labels.limit(0)).count() == 93
    host, path = quality.url_parts(F.lit("https://A.org:80/en/x?y"))
    assert rows.select(host, path).head()[:] == ("a.org", "/en")
