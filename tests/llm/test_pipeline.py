"""The pipeline's stages against plain Python on a small corpus with junk, odd texts and copies."""

import random
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(9)
    vocabulary = {lang: ["".join(r.choice(letters) for _ in range(r.randint(3, 8))) for _ in range(200)] for lang, letters in (("en", "abcdefgh"), ("fr", "éàmnopqr"))}
    docs, copies = [], {}
    for i in range(90):
        lang = "en" if i % 3 else "fr"
        words = [r.choice(vocabulary[lang]) for _ in range(r.randint(30, 90))]
        docs.append((i, " ".join(words) + ".", lang, "big" if i % 4 else "small", 0))
        if i % 10 == 0:
            again = [w if r.random() > 0.01 else "changed" for w in words]
            docs.append((1000 + i, " ".join(again) + ".", lang, "big", 0))
            copies[1000 + i] = i
    junk = [(2000 + i, "BUY!!! NOW!!! $$$ " * (10 + i), "en", "junk", 0) for i in range(30)]
    odd = [(3000, None, None, None, None), (3001, "", "en", "big", 0), (3002, "1234 5678 9.", None, "big", 0)]
    return docs, junk, odd, copies


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    docs, junk, odd, _ = corpus()
    spark.createDataFrame(docs + junk + odd, SCHEMA).selectExpr("*", "1 AS tokens", "'x' AS host").write.parquet(str(path / "documents.parquet"))
    labels = [(d[0], 1, 0) for d in docs[::2]] + [(j[0], 0, 0) for j in junk[::2]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def similar(a: str, b: str) -> bool:
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    both = len(sets[0] & sets[1])
    return 100 * both >= 80 * (len(sets[0]) + len(sets[1]) - both)


def test_stages_and_result(spark, folder):
    docs, junk, odd, copies = corpus()
    texts = {d[0]: d[1] for d in docs}
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    columns = rows.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, folder)
        assert rows.columns == columns, name
        path = f"{folder}/{name}"
        rows.write.parquet(path)
        rows = spark.read.parquet(path)
        kept.append([r.doc_id for r in rows.select("doc_id").collect()])
    quality, language, single, mixed = kept
    assert {d[0] for d in docs} <= set(quality) and not {j[0] for j in junk} & set(quality)
    assert set(language) == set(quality) - {o[0] for o in odd}
    wanted = {i for i in language if not any(similar(texts[i], texts[j]) for j in language if j < i)}
    assert sorted(single) == sorted(wanted) and not {c for c in copies if similar(texts[c], texts[copies[c]])} & wanted
    assert set(mixed) == set(single) and max(mixed.count(i) for i in set(mixed)) <= 2
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {i: len(tokenizer.encode(texts[i], add_special_tokens=False).ids) + 1 for i in set(mixed)}
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, folder).toPandas()
    assert packed.groupby("doc_id")["length"].sum().to_dict() == {i: sizes[i] * mixed.count(i) for i in sizes}
    filled = packed.groupby("sequence_id")["length"].sum()
    assert filled.max() <= 1024 and len(filled) <= np.ceil(filled.sum() / 1024 * 1.1) + 1
    ran = corpus_pipeline.run(spark, folder).toPandas()
    assert ran.groupby("doc_id")["length"].sum().to_dict() == packed.groupby("doc_id")["length"].sum().to_dict()


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_that_repeat_an_id_are_one_document(spark):
    rows = spark.createDataFrame([(1, "a b c d e f", "en", "s", 0)] * 3 + [(None, "a b c d e f", "en", "s", 0)] * 2, SCHEMA)
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_dedup(spark, rows, "").collect()) == ["1", "None", "None"]
