"""Packing documents into sequences: cutting-stock patterns, assigned to documents ranked within their length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, table
from .cutting_stock import Pattern, plan

END_ID = 0
#: Ranks are counted in so many buckets per length, so that no task holds all documents of one length.
BUCKETS = 64
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
LATIN_END = "ɐ"


class _Unsafe(Exception):
    """A part of a text that can't be encoded apart from what precedes it."""


class ChunkEncoder:
    """Ids of the tokenizers library, as little-endian unsigned 32-bit numbers, with those of frequent words kept.

    A byte-level pattern never joins what stands before a space to that space when the character before it is
    no white space, so a text of such words is encoded word by word. Any other text goes to the library whole.
    """

    def __init__(self, path: str, keep: int = 100_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = list({x.content for x in self.library.get_added_tokens_decoder().values()})
        self.fast = self._ranks(path)
        self.kept, self.old, self.keep = {}, {}, keep

    def _ranks(self, path: str):
        """The same vocabulary in tiktoken, for words of Latin letters; None where the file has no such form."""
        import json

        import public_tokenizers
        import tiktoken

        model = json.loads(self.library.to_str())["model"]
        symbols = _byte_symbols()
        if model.get("type") != "BPE" or any(ch not in symbols for word in model["vocab"] for ch in word if word not in self.special):
            return None
        ranks = {bytes(symbols[ch] for ch in word): i for word, i in model["vocab"].items() if word not in self.special}
        return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> bytes:
        if self.fast is not None and max(text) < LATIN_END:
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        return self._whole(text)

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        ids = self.kept.get(word)
        if ids is None:
            ids = self.old.get(word)
            if ids is None:
                if not word or word[-1].isspace():
                    raise _Unsafe
                ids = self._plain(" " + word)
            if len(word) <= 64:
                if len(self.kept) >= self.keep:
                    self.kept, self.old = {}, self.kept
                self.kept[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(x in text for x in self.special):
            return self._whole(text)
        words = text.split(" ")
        try:
            if not words[0] or words[0][-1].isspace():
                raise _Unsafe
            rest = list(map(self.kept.get, words[1:]))
            if None in rest:
                rest = [self._word(w) if x is None else x for w, x in zip(words[1:], rest)]
            return self._plain(words[0]) + b"".join(rest)
        except _Unsafe:
            return self._whole(text)


def _byte_symbols() -> dict[str, int]:
    """The character by which byte-level vocabularies write each byte: printable ones themselves, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@cache
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def cut(documents: DataFrame, tokenizer_path: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """The pieces of each document, cut at multiples of the capacity."""
    out = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer_path).encode
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = ids_of(text) + end
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    rows.append((doc, s, min(capacity, n - s), zlib.crc32(ids[4 * s : 4 * (s + capacity)]), n))
            yield batch(out, [list(x) for x in zip(*rows)] or [[]] * 5)

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(pieces, PIECES)


def slots(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Which ranks of a length go to which sequences: arrays sorted by (length, first rank)."""
    seen: dict[int, int] = {}
    rows, sequence = [], 0
    for p in patterns:
        inner = 0
        for length, n in zip(p.lengths, p.counts):
            first = seen.get(length, 0)
            rows.append((length, first, sequence, n, inner))
            seen[length] = first + n * p.times
            inner += n * length
        sequence += p.times
    a = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "sequence", "each", "inner"), a.T))


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs documents into sequences of at most `capacity` tokens.

    A document's ids are the library's, without special tokens added, then END_ID; a null or empty text is
    END_ID alone, a null id stays null, and repeated rows are packed once each. Each document is cut at
    multiples of the capacity (so a text of any length is packed whole; an empty table gives no rows; other columns, whatever
    their names, aren't looked at); whole pieces fill a sequence each, the last piece of each document is an item of
    the cutting-stock problem over the histogram of lengths (at most `capacity` numbers reach the driver). Its
    linear program is solved by column generation, patterns are rounded down, and what is left, fewer pieces
    than a thousand sequences hold, is fitted. Pieces are ranked within their length, in BUCKETS parts so that
    no length lands in one task, and ranges of ranks go to the slots of the patterns.

    Returns per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    spark = documents.sparkSession
    bucket = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(BUCKETS)).cast("int")
    pieces = table(cut(documents, tokenizer_path, capacity, id_col, text_col).withColumn("bucket", bucket), "pieces")
    counts = table(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")).coalesce(1), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    taken = spark.sparkContext.broadcast(slots(plan(histogram, capacity)))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(within) - 1).join(F.broadcast(bases), ["length", "bucket"])  # at most capacity * BUCKETS rows
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank")).alias("rank"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    out = pa.schema([(n, pa.int64()) for n in names])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = taken.value
        keys = (at["length"] << 44) + at["first"]
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 5))
            i = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            beyond = rank - at["first"][i]
            each = at["each"][i]
            yield batch(out, [*(b.column(k) for k in range(5)), at["sequence"][i] + beyond // each, at["inner"][i] + beyond % each * length])

    return ranked.mapInArrow(place, ", ".join(f"{n} long" for n in names))
