"""Language identification: each text is a mixture of languages whose proportions expectation-maximisation finds."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, held_out

BITS = 16  # n-grams are hashed to 2 ** BITS counters
#: A further language must raise the log-likelihood by this much per log of the number of n-grams (BIC has 0.5).
PENALTY = 3.0
ROUNDS = 30


class Model(NamedTuple):
    languages: list[str]
    logs: np.ndarray  # (language, hashed n-gram) natural log of its probability


def grams(text: str) -> np.ndarray:
    """Hashes of all three-byte n-grams of a whole lower-cased text in UTF-8, with a space before and after."""
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    codes = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    return (codes * np.uint32(2654435769)) >> np.uint32(32 - BITS)


def learn(documents: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """N-gram counts of all given documents of a language that isn't null. Each task adds up its own documents, so
    what is shuffled and what reaches the driver is bounded by languages x 2 ** BITS numbers."""
    out = pa.schema([("lang", pa.string()), ("gram", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text:
                    sums[lang] = sums.get(lang, 0) + np.bincount(grams(text), minlength=1 << BITS)
        for lang, n in sums.items():
            some = np.flatnonzero(n)
            yield batch(out, [[lang] * len(some), some.astype(np.int32), n[some].astype(np.int64)])

    rows = documents.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    counts = np.full((len(languages), 1 << BITS), 0.5)
    for i, lang in enumerate(languages):
        own = found[found["lang"] == lang]
        counts[i, own["gram"].to_numpy()] += own["n"].to_numpy()
    return Model(languages, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32) if languages else counts)


def proportions(likelihoods: np.ndarray, counts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """EM for the weights of a mixture: likelihoods (language, n-gram), counts of n-grams. Weights and log-likelihood."""
    weights = start
    for _ in range(ROUNDS):
        mixed = weights @ likelihoods
        new = weights * (likelihoods @ (counts / mixed)) / counts.sum()
        done = np.abs(new - weights).max() < 1e-4
        weights = new / new.sum()
        if done:
            break
    return weights, float(counts @ np.log(weights @ likelihoods))


def mixture(logs: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The proportions of all languages in one text; those of languages outside the selected set are 0.

    The set starts as the likeliest language alone. As long as the log-likelihood rises on the way towards some
    other language (Lindsay's gradient is positive), the steepest is tried; it joins if its EM fit beats the penalty.
    """
    kinds, counts = np.unique(codes, return_counts=True)
    own = logs[:, kinds].astype(np.float64)
    like, counts = np.exp(own - own.max(axis=0)), counts.astype(np.float64)
    n, total = len(logs), counts.sum()
    weights = np.zeros(n)
    alone = own @ counts
    weights[alone.argmax()] = 1.0
    level = float(counts @ np.log(np.maximum(weights @ like, 1e-300)))
    while (weights > 0).sum() < n:
        gradient = like @ (counts / np.maximum(weights @ like, 1e-300)) - total
        gradient[weights > 0] = -np.inf
        k = int(gradient.argmax())
        if gradient[k] <= 0:
            break
        start = weights * 0.9
        start[k] = 0.1
        chosen = np.flatnonzero(start)
        fitted, reached = proportions(like[chosen], counts, start[chosen])
        if reached - level <= PENALTY * np.log(total):
            break
        weights, level = np.zeros(n), reached
        weights[chosen] = fitted
    return weights


def identify(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: list | None = None) -> DataFrame:
    """Per row: doc_id, lang_pred, score (that language's proportion, 0 to 1), languages (how many were selected).

    Nothing but the text is an input. A text that is null, empty or without a letter (Unicode's categories L) is `und` with
    score 0, as is any text if no language was learnt. Whole texts are used, ties go to the language that sorts first; a null
    id stays null; equal texts have equal results; an empty table gives no rows. `extra` columns are passed through under
    their own aliases; no other column is looked at.
    """
    extra = extra or []
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, logs = sent.value
        for b in batches:
            names, scores, kinds = [], [], []
            for text in b.column(0).to_pylist():
                if not text or not languages or not any(map(str.isalpha, text)):
                    names.append("und"), scores.append(0.0), kinds.append(0)
                    continue
                w = mixture(logs, grams(text))
                names.append(languages[int(w.argmax())]), scores.append(float(w.max())), kinds.append(int((w > 0).sum()))
            done = [pa.array(names), pa.array(scores, pa.float64()), pa.array(kinds, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(1, b.num_columns)), *done], names=[*b.schema.names[1:], "lang_pred", "score", "languages"])

    rows = documents.select(F.col(text_col).cast("string").alias("text_"), F.col(id_col).cast("long").alias("doc_id"), *extra)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(predict, f"{kinds}, lang_pred string, score double, languages long")


def language_of(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learnt from those whose crc32(doc_id) mod 3 isn't 1."""
    out = held_out("doc_id", 3, 1)
    model = learn(documents.where(~out))
    return identify(documents, model, extra=[out.alias("held_out")]).select("doc_id", "held_out", "lang_pred", "score", "languages")
