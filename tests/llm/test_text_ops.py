import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strophe.llm import cutting_stock, near_dedup
from strophe.llm.bpe_count import MergeCounter, count_tokens
from strophe.llm.language_id import grams, identify, language_of, learn, mixture
from strophe.llm.near_dedup import band_shape, near_duplicates, shingle_set, sketch, WordHashes
from strophe.llm.packing import ChunkEncoder, pack

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a", "  two  blanks ", "line\nbreaks\n\n here", "▁mark", "漢字 and 😀 é", "<s>x</s> <|endoftext|> y", "tab\tx", "\x00zero", "nbsp x   y", "word." * 300]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
COUNTER, LIBRARY = MergeCounter.from_model(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
ENCODER, TOKENIZER = ChunkEncoder(BYTES), Tokenizer.from_file(BYTES)


@pytest.mark.parametrize("text", ODD)
def test_counts_and_ids_are_the_libraries(text):
    assert COUNTER.count(text) == len(LIBRARY.encode(text))
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("ab the.,\n \t▁éß漢", max_size=60)))
def test_any_text_counts_and_encodes_alike(text):
    assert COUNTER.count(text) == len(LIBRARY.encode(text))
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_ids_of_the_whole_vocabulary_and_of_real_texts_are_the_libraries():
    words = [w for w in (TOKENIZER.decode([i]) for i in range(TOKENIZER.get_vocab_size())) if w and "\ufffd" not in w]
    texts = [" ".join(words[k : k + 40]) for k in range(0, len(words), 40)]
    folder = Path("/root/testdata/sf0.01/documents.parquet")
    if folder.exists():
        import pyarrow.parquet as pq

        texts += pq.read_table(folder, columns=["text"]).column("text").to_pylist()
    for text, right in zip(texts, TOKENIZER.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == right.ids


def test_kept_counts_are_bounded():
    small = MergeCounter.from_model(PIECES, keep=3)
    assert [small.count(t) for t in ODD * 2] == [COUNTER.count(t) for t in ODD * 2]
    assert len(small.whole) <= 3


def test_token_counts_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, None), (None, "a b"), (2, ""), (2, ""), (3, "x " * 5000)], "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "2 AS over_limit")
    found = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(rows, PIECES).collect())
    assert found == [(0, 3, len(LIBRARY.encode("a b")), False), (1, 0, 0, False), (2, 0, 0, False), (2, 0, 0, False), (3, 10000, len(LIBRARY.encode("x " * 5000)), True)]
    assert count_tokens(rows.limit(0), PIECES).count() == 0


def test_plan_covers_the_histogram():
    r = random.Random(5)
    for n in (1, 2, 40, 400):
        lengths = [r.randint(1, 64) for _ in range(n)]
        histogram = {x: lengths.count(x) for x in set(lengths)}
        patterns = cutting_stock.plan(histogram, 64)
        used: dict[int, int] = {}
        for p in patterns:
            assert sum(a * b for a, b in zip(p.lengths, p.counts)) <= 64
            for a, b in zip(p.lengths, p.counts):
                used[a] = used.get(a, 0) + b * p.times
        assert used == histogram
        assert sum(p.times for p in patterns) <= sum(lengths) / 64 * 1.25 + 1


def test_knapsack_is_optimal():
    lengths, values = np.array([3, 5, 7]), np.array([0.31, 0.55, 0.74])
    best, counts = cutting_stock.best_pattern(values, lengths, 16)
    all_ = max(a * 0.31 + b * 0.55 + c * 0.74 for a in range(6) for b in range(4) for c in range(3) if 3 * a + 5 * b + 7 * c <= 16)
    assert best == pytest.approx(all_) and counts @ lengths <= 16


def test_pieces_are_whole_and_gapless(spark):
    texts = [None, "", "one two three", "one two three", "many words " * 900, "many words " * 900, *ODD]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(None, "no id"), (3, "one two three")], "doc_id long, text string").selectExpr("*", "0 AS start", "0 AS length", "'x' AS bucket")
    found = pack(rows, BYTES, 256).collect()
    sequences: dict[int, list] = {}
    documents: dict = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append(r)
        documents.setdefault(r.doc_id, []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    for i, text in enumerate(texts):
        ids = np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at, own = 0, sorted(documents[i], key=lambda r: (r.start, r.sequence_id))
        own = own if i != 3 else own[::2]
        for r in own:
            assert (r.start, r.doc_tokens) == (at, len(ids)) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    assert len(documents[3]) == 2 and len(documents[None]) == 1
    assert pack(rows.limit(0), BYTES, 256).count() == 0


def brute_components(texts: dict, width: int, percent: int) -> dict:
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    label = {i: i for i in texts}
    for _ in texts:
        for a in texts:
            for b in texts:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in texts}


def test_sketch_fills_and_estimates():
    r, h = random.Random(2), WordHashes()
    for n in (1, 3, 50, 3000):
        words = [f"w{r.randrange(10**6)}" for _ in range(n)]
        a = shingle_set(" ".join(words), 1, h)
        s = sketch(a, 256)
        assert s.max() != np.iinfo(np.uint64).max
        half = shingle_set(" ".join(words[: n // 2] + [f"v{k}" for k in range(n - n // 2)]), 1, h)
        both = len(np.intersect1d(a, half))
        assert abs((sketch(half, 256) == s).mean() - both / (len(a) + len(half) - both)) < 0.15
    bands, rows = band_shape(85)
    assert (1 - 0.85**rows) ** bands < 1e-5


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    texts, i = {}, 0
    for _ in range(12):
        base = [word() for _ in range(r.randint(1, 120))]
        for _ in range(r.randint(1, 8)):
            copy = [word() if r.random() < 0.02 else w for w in base]
            texts[i] = " ".join(copy) + r.choice(["", " ", "\n"])
            i += 1
    texts |= {i: None, i + 1: "", i + 2: "Same", i + 3: "same", i + 4: " \n "}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "'x' AS fingerprint", "1 AS rep")
    found = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates(rows, 3, 85).collect()}
    assert found == brute_components(texts, 3, 85)


def test_near_duplicates_of_odd_rows(spark):
    rows = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (9, "A  b c")], "doc_id long, text string")
    found = sorted((x.doc_id or -1, x.component_id or -1, x.kept) for x in near_duplicates(rows).collect())
    assert found == [(-1, -1, True), (5, 5, True), (5, 5, True), (9, 5, False)]
    assert near_duplicates(rows.limit(0)).count() == 0


TONGUES = {"aa": "kala mata sola tira puna", "bb": "grunt schlecht durch nacht wolf", "cc": "été père où ça façon élève"}


def sentences(lang: str, n: int, seed: int) -> str:
    r = random.Random(f"{lang}{seed}")
    return " ".join(r.choice(TONGUES[lang].split()) for _ in range(n))


def test_language_of_texts_and_mixtures(spark):
    docs = [(i, sentences(lang, 40, i), lang, "s", 0) for i, lang in enumerate([*TONGUES] * 20)]
    odd = [(900, None, "aa", None, 0), (901, "", None, "s", 0), (902, "12 !?", None, "s", 0), (None, sentences("bb", 9, 1), None, "s", 0)]
    rows = spark.createDataFrame(docs + odd, DOCS).selectExpr("*", "1.0 AS score", "'q' AS lang_pred")
    found = {r.doc_id: r for r in language_of(rows).collect()}
    assert all(found[i].lang_pred == lang for i, _, lang, *_ in docs)
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in docs)
    assert [found[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and found[None].lang_pred == "bb"
    model = learn(rows)
    shares = mixture(model.logs, grams(sentences("aa", 60, 7) + " " + sentences("cc", 60, 8)))
    assert model.languages == [*TONGUES] and shares[1] == 0 and 0.3 < shares[0] < 0.7
    empty = rows.limit(0)
    assert identify(empty, learn(empty)).count() == 0
    assert {r.lang_pred for r in identify(rows, learn(empty)).collect()} == {"und"}


def plain_mixture(logs: np.ndarray, codes: np.ndarray) -> list[float]:
    """mixture() with the EM of every set spelled out n-gram by n-gram."""
    tokens = [np.exp(logs[:, g].astype(float) - logs[:, g].astype(float).max()) for g in codes]
    n = len(logs)

    def likelihood(w):
        return sum(np.log(max(1e-300, sum(w[k] * t[k] for k in range(n)))) for t in tokens)

    alone = [sum(float(logs[k, g]) for g in codes) for k in range(n)]
    w = [float(k == int(np.argmax(alone))) for k in range(n)]
    level = likelihood(w)
    while sum(x > 0 for x in w) < n:
        slope = [sum(t[k] / max(1e-300, sum(w[j] * t[j] for j in range(n))) for t in tokens) - len(tokens) if not w[k] else -np.inf for k in range(n)]
        new = int(np.argmax(slope))
        if slope[new] <= 0:
            break
        tried = [0.9 * x for x in w]
        tried[new] = 0.1
        for _ in range(30):
            shares = [sum(tried[k] * t[k] / sum(tried[j] * t[j] for j in range(n)) for t in tokens) / len(tokens) for k in range(n)]
            done = max(abs(a - b) for a, b in zip(shares, tried)) < 1e-4
            tried = [x / sum(shares) for x in shares]
            if done:
                break
        reached = likelihood(tried)
        if reached - level <= 3.0 * np.log(len(tokens)):
            break
        w, level = tried, reached
    return w


def test_mixtures_against_plain_em(spark):
    docs = [(i, sentences(lang, 40, i), lang, "s", 0) for i, lang in enumerate([*TONGUES] * 8)]
    model = learn(spark.createDataFrame(docs, DOCS))
    r = random.Random(7)
    for k in range(12):
        text = " ".join(sentences(r.choice([*TONGUES]), r.randint(1, 40), k * 10 + j) for j in range(r.randint(1, 3)))
        assert mixture(model.logs, grams(text)) == pytest.approx(plain_mixture(model.logs, grams(text)), abs=1e-6)
    odd = spark.createDataFrame([(1, "² ½ Ⅷ 12"), (2, "x"), (3, sentences("bb", 30_000, 1)), (4, "漢")], "doc_id long, text string").selectExpr("*", "'z' AS lang_pred", "1 AS languages", "'q' AS text_")
    found = {x.doc_id: x.lang_pred for x in identify(odd, model).collect()}
    assert found[1] == "und" and found[2] != "und" and found[3] == "bb" and found[4] != "und"


def test_the_linear_program_sets_the_plan():
    r, capacity = np.random.default_rng(0), 100
    lengths = np.sort(r.choice(np.arange(15, 60), 12, replace=False))
    demand = r.integers(10, 60, 12).astype(float)
    start = cutting_stock.first_basis(demand, lengths, capacity)[1].sum()
    columns, x, bound = cutting_stock.relaxed(demand, lengths, capacity, 0.0)
    assert np.allclose(columns @ x, demand) and (columns >= -1).all() and (x >= -1e-9).all()
    total = x[columns.min(axis=0) >= 0].sum()
    assert bound <= total + 1e-6 and total < start - 2
    prices = np.linalg.solve(columns.T, (columns.min(axis=0) >= 0).astype(float))
    worth = cutting_stock.best_pattern(np.maximum(prices, 0), lengths, capacity)[0]
    assert np.ceil(total - 1e-6) == np.ceil(bound - 1e-6) or worth <= 1 + 1e-6
    plan = cutting_stock.plan(dict(zip(lengths.tolist(), demand.astype(int).tolist())), capacity)
    assert sum(p.times for p in plan) <= np.ceil(total) + 2


def test_rows_of_one_id_are_told_apart(spark):
    rows = [(1, "a b c d e f g h"), (1, "q r s t u v w x"), (1, "a b c d e f g h"), (2, "q r s t u v w x y"), (3, "Q r s t u v w x")]
    found = sorted((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == [(1, 4, 1, True), (1, 4, 1, True), (1, 4, 1, True), (2, 5, 1, False), (3, 4, 1, False)]


def test_open_buckets_are_met_in_blocks(spark, monkeypatch):
    """A family around one text, its outer members near one another or near none, against brute force with small blocks."""
    monkeypatch.setattr("strophe.llm.near_dedup.BLOCK", 5)
    r = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(60):
        words = list(base)
        for k in r.sample(range(60), r.choice([0, 1, 2, 3, 4, 5, 6])):
            words[k] = f"x{r.randrange(40)}"
        texts[i] = " ".join(words)
    texts[60] = " ".join(f"v{i}" for i in range(30_000))
    texts[61] = texts[60] + " more"
    found = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 3, 80).collect()}
    assert found == brute_components(texts, 3, 80) and len({c for _, c in found.values()}) > 3
    assert near_dedup.shared_sizes([np.array([1, 4, 9], np.uint64), np.array([2], np.uint64)], [np.array([4, 9, 10], np.uint64)], 1).tolist() == [[2], [0]]


def test_digest_helper():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
