"""Language-model scores of whole documents: a gated recurrent model over counts of the whole training corpus."""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import batch, held_out, table, words

#: The recurrent model starts from a fit on the first training documents by hash of their id: up to so many, and up to about so many words.
SAMPLE_WORDS = 300_000
SAMPLE_DOCUMENTS = 4_000
ROUNDS, RATE = 2, 0.01  # in which all training documents are learnt from, each in one; the rate falls from round to round
PIECES = 64  # of the parameters, that are averaged apart
WORDS = 4096  # of the recurrent model; all others are one word to it, told apart by their counts
HEAD = 200_000  # words whose counts every task holds; others' are joined
HIDDEN, EMBED = 16, 12
FLUSH = 300_000
TOGETHER = 8192  # documents scored together


def count_words(documents: DataFrame) -> DataFrame:
    """(word, n) over all words of the texts; each task sums up what it reads before anything is shuffled."""
    out = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def given(counts: Counter) -> Iterator[pa.RecordBatch]:
        items = list(counts.items())
        for at in range(0, len(items), 50_000):
            some = items[at : at + 50_000]
            yield batch(out, [[w.decode() for w, _ in some], [n for _, n in some]])
        counts.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                counts.update(words(text))
                if len(counts) > FLUSH:
                    yield from given(counts)
        yield from given(counts)

    return documents.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_of(vocabulary: DataFrame, most: int) -> pa.Table:
    """The most frequent words, at most `most`, the more frequent first; counts that straddle the bound are left out whole."""
    level = F.floor(F.log2("n") * 16).cast("int")
    sizes = {r.level: r.words for r in vocabulary.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()}  # at most 16 * 64 rows
    kept, least = 0, None
    for at in sorted(sizes, reverse=True):
        kept += sizes[at]
        if kept > most:
            break
        least = at
    if least is None:
        return pa.table({"word": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
    return vocabulary.where(level >= least).toArrow().sort_by([("n", "descending"), ("word", "ascending")])


def started(training: DataFrame, numbers: dict[bytes, int], counts: np.ndarray) -> gru.Model:
    """The recurrent model to begin with, fitted in one task on a sample of whole training documents; see SAMPLE_WORDS."""
    spark = training.sparkSession
    size = F.length(F.coalesce("text", F.lit("")))
    lengths = training.select("doc_id", size.alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id", "size").limit(SAMPLE_DOCUMENTS).collect()
    ids, total = [], 0
    for r in lengths:
        if total >= SAMPLE_WORDS * 6:
            break
        ids.append(r.doc_id)
        total += r.size
    chosen = training.where(F.col("doc_id").isin([i for i in ids if i is not None])).select("doc_id", "text").collect()
    place = {doc: i for i, doc in enumerate(ids)}
    sample = [words(r.text) for r in sorted(chosen, key=lambda r: (place[r.doc_id], r.text or ""))]
    sent = spark.sparkContext.broadcast(([np.array([numbers.get(w, gru.OTHER) for w in s] + [gru.END]) for s in sample], counts))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                texts, counts = sent.value
                model = gru.train(gru.new(counts, HIDDEN, EMBED), texts)
                yield batch(pa.schema([("model", pa.binary())]), [[pickle.dumps(model)]])

    return pickle.loads(spark.range(1, numPartitions=1).mapInArrow(fit, "model binary").head()[0])


def fitted(training: DataFrame, numbers: dict[bytes, int], model: gru.Model) -> gru.Model:
    """The model after ROUNDS over disjoint shares, by hash, that hold all training documents.

    In a round each task trains the model on what it reads of the share; the parameters are averaged by numbers of words,
    piece by piece, so that no task holds more than a piece of every task's.
    """
    spark = training.sparkSession
    names, sizes = gru.PARAMETERS, [getattr(model, p).size for p in gru.PARAMETERS]
    schema = pa.schema([("piece", pa.int32()), ("task", pa.int32()), ("n", pa.int64()), ("part", pa.binary())])
    for at in range(ROUNDS):
        sent = spark.sparkContext.broadcast((model, numbers))
        rate = RATE * (1 - at / ROUNDS)

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, numbers = sent.value
            own = model._replace(**{p: getattr(model, p).copy() for p in names})
            texts = (text for b in batches for text in b.column(0).to_pylist())
            n = gru.train_all(own, (np.array([numbers.get(w, gru.OTHER) for w in words(text)] + [gru.END]) for text in texts), rate)
            if n:
                flat = np.concatenate([getattr(own, p).ravel() for p in names])
                task = TaskContext.get().partitionId()
                yield batch(schema, [list(range(PIECES)), [task] * PIECES, [n] * PIECES, [x.tobytes() for x in np.array_split(flat, PIECES)]])

        def mean(parts: pa.Table) -> pa.Table:
            parts = parts.sort_by("task")
            n = parts.column("n").to_numpy()
            whole = sum(np.frombuffer(x.as_py(), np.float32) * (k / n.sum()) for x, k in zip(parts.column("part"), n))
            return pa.table([parts.column("piece")[:1], parts.column("task")[:1], [int(n.sum())], [whole.astype(np.float32).tobytes()]], schema=schema)

        kinds = "piece int, task int, n long, part binary"
        share = training.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == at).select("text")
        found = share.mapInArrow(learn, kinds).groupBy("piece").applyInArrow(mean, kinds).collect()
        if found:
            flat = np.concatenate([np.frombuffer(r.part, np.float32) for r in sorted(found, key=lambda r: r.piece)])
            parts = np.split(flat, np.cumsum(sizes)[:-1])
            model = model._replace(**{p: x.reshape(getattr(model, p).shape) for p, x in zip(names, parts)})
    return model


def scored(documents: DataFrame, out_of_training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of documents: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text is its end alone; a text of any length is scored whole; a null id stays null; repeated rows are scored
    alike; an empty table gives no rows; other columns, whatever their names, aren't looked at; without training
    documents nothing is known and both scores rest on one unknown token. base_score is the add-one unigram score.
    score is the recurrent model's, which learns from all training documents (by which task reads them, see fitted()): of a word beyond its WORDS, the probability of such a word times its add-one share
    among those. Counts are of all training words: the HEAD most frequent are sent to every task, the others'
    are joined to the (document, rare word) pairs.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), out_of_training.alias("held_out"))
    training = docs.where(~F.col("held_out")).select("doc_id", "text")
    vocabulary = table(count_words(training), "words")
    ends = training.count()
    n_words, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head()
    n, v = n_words + ends, distinct + (ends > 0)
    head = head_of(vocabulary, HEAD)
    head_words, head_counts = [w.encode() for w in head.column("word").to_pylist()], head.column("n").to_numpy()
    inside = min(WORDS - 2, len(head_words))
    numbers = {w: i + 2 for i, w in enumerate(head_words[:inside])}
    beyond, beyond_kinds = int(n_words - head_counts[:inside].sum()), distinct - inside
    if ends:
        model = fitted(training, numbers, started(training, numbers, np.array([ends, beyond, *head_counts[:inside]], dtype=float)))
    else:
        model = gru.new(np.ones(2), HIDDEN, EMBED)
    sent = spark.sparkContext.broadcast((model, head_words, head_counts))
    base = lambda c: np.log10((c + 1) / (n + v + 1))
    share = lambda c: np.log10((c + 1) / (beyond + beyond_kinds + 1))
    fields = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.string()))]
    out = pa.schema([("row", pa.string()), *fields])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, head_words, head_counts = sent.value
        place = {w: i for i, w in enumerate(head_words)}.get
        bases, shares = base(head_counts.astype(float)), np.where(np.arange(len(head_counts)) < inside, 0.0, share(head_counts.astype(float)))
        scorer = gru.Scorer(model)
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                b = whole.slice(at, TOGETHER)
                texts, known, sums, more, rare = [], [], [], [], []
                for text in b.column(1).to_pylist():
                    found = words(text)
                    i = np.array([place(w, -1) for w in found], dtype=np.int64)
                    have = i[i >= 0]
                    texts.append(np.append(np.where((i >= 0) & (i < inside), i + 2, gru.OTHER), gru.END))
                    known.append(len(have) + (ends > 0))
                    sums.append(bases[have].sum() + base(ends))
                    more.append(shares[have].sum())
                    rare.append([found[k].decode() for k in np.flatnonzero(i < 0)] if len(have) < len(found) else None)
                logs = scorer.score(texts) / np.log(10)
                yield batch(out, [b.column(3), b.column(0), b.column(2), [len(t) for t in texts], known, sums, logs + np.array(more), rare])

    row = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text").cast("string"))  # rows of equal id and text score alike
    kinds = "row string, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<string>"
    rows = table(docs.withColumn("row", row).select("doc_id", "text", "held_out", "row").mapInArrow(score, kinds), "scored")
    pairs = rows.where("rare IS NOT NULL").dropDuplicates(["row"]).select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    found = pairs.join(vocabulary, "word", "left").withColumn("c", F.coalesce("n", F.lit(0)).cast("double"))
    log = lambda bottom: F.log10((F.col("c") + 1) / F.lit(float(bottom)))
    added = found.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * log(n + v + 1)).alias("more_base"),
        F.sum(F.col("times") * log(beyond + beyond_kinds + 1)).alias("more_score"),
    )
    zero = lambda c, like: F.coalesce(F.col(c), F.lit(like))
    return rows.join(added, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("more_known", 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base", 0.0)).alias("base_score"), (F.col("score") + zero("more_score", 0.0)).alias("score"),
    )


def score_documents(documents: DataFrame) -> DataFrame:
    """scored(), learning from the documents whose crc32(doc_id) mod 7 isn't 2."""
    return scored(documents, held_out("doc_id", 7, 2))
