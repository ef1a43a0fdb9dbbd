"""Quality by hierarchical empirical Bayes: a document's own evidence, and its host's and path's posteriors."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, table, words

#: The classifier is fitted on so many labelled documents at most, those that come first by a hash of their id.
LABELLED = 6000
RIDGE = 1.0
#: Byte groups whose shares of a text are features.
GROUPS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".", "comma": b",;:", "shout": b"!?", "mark": b"#$%&*@^~", "bar": b"|", "bracket": b"<>{}[]()=\\/_", "quote": b"\"'`", "space": b" \t", "line": b"\n\r", "other": bytes(range(128, 256))}
FEATURES = [*GROUPS, "log_words", "word_length", "distinct", "top_word", "lines_again", "triples_again", "long_words"]
PICK = np.array([[b in own for b in range(256)] for own in GROUPS.values()], dtype=float)


class Classifier(NamedTuple):
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # with the intercept last
    prior: float  # share of good documents among those fitted on


def features(text: str | None) -> list[float]:
    """Measures of a whole text's shape; those of a text without words are 0."""
    found = words(text)
    n = len(found)
    if not n:
        return [0.0] * len(FEATURES)
    raw = text.encode()
    shares = PICK @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw)
    counts: dict[bytes, int] = {}
    for w in found:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    triples = max(1, n - 2)
    again = 1 - len(set(zip(found, found[1:], found[2:]))) / triples if n > 2 else 0.0
    return [*shares, np.log1p(n), len(raw) / n, len(counts) / n**0.8, max(counts.values()) / n, 1 - len(set(lines)) / max(1, len(lines)), again, sum(len(w) > 20 for w in found) / n]


def fit(x: np.ndarray, y: np.ndarray) -> Classifier:
    """Ridge logistic regression by Newton's method; with labels of one kind, or none, the prior alone."""
    prior = (y.sum() + 1) / (len(y) + 2)
    centre = x.mean(axis=0) if len(x) else np.zeros(len(FEATURES))
    scale = x.std(axis=0) + 1e-9 if len(x) else np.ones(len(FEATURES))
    w = np.zeros(len(FEATURES) + 1)
    w[-1] = np.log(prior / (1 - prior))
    if 0 < y.sum() < len(y):
        z = np.column_stack([np.clip((x - centre) / scale, -8, 8), np.ones(len(x))])
        hold = np.full(z.shape[1], RIDGE)
        hold[-1] = 1e-6
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(hold), z.T @ (y - p) - hold * w)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
    return Classifier(centre, scale, w, float(prior))


def _measured(rows: DataFrame) -> DataFrame:
    """features() of the column `text`, beside doc_id and y."""
    out = pa.schema([("y", pa.float64()), ("f", pa.list_(pa.float64()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(out, [b.column(1), [features(t) for t in b.column(0).to_pylist()]])

    return rows.select("text", "y").mapInArrow(measure, "y double, f array<double>")


def train(documents: DataFrame, labels: DataFrame, most: int = LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Classifier:
    """Fits the document classifier on at most `most` labelled documents. Labels that contradict one another are averaged."""
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id_")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    docs = documents.select(F.col(id_col).alias("id_"), F.col(text_col).cast("string").alias("text"))
    known = marks.join(docs.select("id_").distinct(), "id_", "left_semi")
    chosen = known.orderBy(F.xxhash64("id_"), "id_").limit(most)
    rows = _measured(docs.join(F.broadcast(chosen), "id_").groupBy("id_", "y").agg(F.min("text").alias("text"))).collect()  # `most` ids are broadcast
    x = np.array([r.f for r in rows], dtype=float).reshape(-1, len(FEATURES))
    y = np.array([r.y for r in rows], dtype=float)
    order = np.lexsort([*x.T[::-1], y])  # the order of rows mustn't matter
    return fit(x[order], (y[order] >= 0.5).astype(float))


def evidence(documents: DataFrame, model: Classifier, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, host, path, text_hash (xxhash64), p_doc (the classifier's probability that the document is good)."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("text_hash", pa.int64()), ("p_doc", pa.float64())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            x = np.array([features(t) for t in b.column(4).to_pylist()]).reshape(-1, len(FEATURES))
            z = np.clip((x - m.centre) / m.scale, -8, 8) @ m.weights[:-1] + m.weights[-1]
            yield batch(out, [*(b.column(i) for i in range(4)), 1 / (1 + np.exp(-np.clip(z, -20, 20)))])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(judge, "doc_id long, host string, path string, text_hash long, p_doc double")


def concentration(groups: DataFrame, mean: float) -> float:
    """Pseudo-count of the Beta prior by moments: how far rates of groups (s, n, centre) vary beyond chance.

    Groups of one document say nothing of that; where nothing varies beyond chance the prior is as strong as 10,000
    documents.
    """
    rate = F.col("s") / F.col("n")
    r = groups.where("n > 1").agg(
        F.sum(F.col("n") * (rate - F.col("centre")) ** 2).alias("spread"), F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("centre") * (1 - F.col("centre"))).alias("chance")
    ).head()
    if not r.n:
        return 2.0
    chance, between = r.chance / r.n, r.spread / r.n
    kept = mean * (1 - mean)
    beyond = max(between - chance, kept / 10_000)
    return float(min(10_000.0, max(2.0, kept / beyond - 1)))


def judged(rows: DataFrame, prior: float, threshold: float = 0.5) -> DataFrame:
    """Posterior quality of rows (doc_id, host, path, p_doc): sparse sites shrink to what is above them.

    Sums of p_doc per (host, path), and of those per host, are partial aggregates. A host's rate is Beta-shrunk to
    the global rate, a path's rate to its host's; the document is left out of both. The posterior's log odds are the
    path rate's plus the document's evidence against the classifier's prior. A null host or path is a group of its own.
    """
    rows = rows.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    paths = table(rows.groupBy("host", "path").agg(F.sum("p_doc").alias("s"), F.count("*").alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("s").alias("host_s"), F.sum("n").alias("host_n"))
    total = hosts.agg(F.sum("host_s"), F.sum("host_n")).head()
    mean = float(np.clip(total[0] / total[1], 1e-4, 1 - 1e-4)) if total[1] else prior
    strong = concentration(hosts.select(F.col("host_s").alias("s"), F.col("host_n").alias("n"), F.lit(mean).alias("centre")), mean)
    sites = paths.join(hosts, "host")
    centre = (F.col("host_s") + strong * mean) / (F.col("host_n") + strong)
    firm = concentration(sites.select("s", "n", centre.alias("centre")), mean)
    found = rows.join(sites, ["host", "path"])
    host_rate = (F.col("host_s") - F.col("p_doc") + strong * mean) / (F.col("host_n") - 1 + strong)
    path_rate = (F.col("s") - F.col("p_doc") + firm * F.col("host_rate")) / (F.col("n") - 1 + firm)
    bounded = lambda p: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    odds = lambda p: F.log(bounded(p) / (1 - bounded(p)))
    found = found.withColumn("host_rate", host_rate).withColumn("path_rate", path_rate)
    z = odds(F.col("path_rate")) + odds(F.col("p_doc")) - F.lit(float(np.log(prior / (1 - prior))))
    quality = 1 / (1 + F.exp(-z))
    more = [c for c in ("text_hash",) if c in rows.columns]
    return found.select("doc_id", *more, "host", "path", "p_doc", "host_rate", "path_rate", quality.alias("quality"), (quality >= threshold).alias("keep"))


def rated(documents: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, threshold: float = 0.5, text_hash: bool = False) -> DataFrame:
    """One row per row of documents: doc_id, host, path, p_doc, host_rate, path_rate, quality, keep; with text_hash also
    xxhash64 of the text, which tells rows of one id apart.

    host and path default to the source and the language, the sections of these tables. Texts that are null or
    without words have a shape of zeros and are judged by it and by their site; very long texts are read whole; a null id
    stays null; rows that repeat are rated each (equal rows alike); an empty table gives no rows; without labels of both
    kinds the classifier gives the prior for all. A labelled id that stands on several texts teaches the smallest of them.
    Other columns of documents, also such as are named like results, aren't looked at.
    """
    model = train(documents, labels)
    rows = table(evidence(documents, model, F.col("source") if host is None else host, F.col("lang") if path is None else path), "evidence")
    return judged(rows if text_hash else rows.drop("text_hash"), model.prior, threshold)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of a URL."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#:]+)", 1)), F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+(/[^/?#]*)", 1)
