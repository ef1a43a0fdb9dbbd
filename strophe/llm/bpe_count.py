"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are made."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch

MARK = "▁"  # a space, as the vocabulary writes it
SEGMENT = re.compile(" *[^ ]+| +")


class MergeCounter:
    """Counts tokens as sentencepiece's byte-pair model with byte fallback does.

    A symbol of the text that the vocabulary lacks counts as its UTF-8 bytes. A text is cut where no piece
    of the vocabulary could span the cut, so each part is merged alone and its count kept for its next
    occurrence; `keep` bounds how many are kept.
    """

    def __init__(self, ranks: dict[str, int], keep: int = 300_000):
        self.joins = {piece[i : i + 2] for piece in ranks for i in range(len(piece) - 1)}
        self.number = {piece: i for i, piece in enumerate(ranks)}
        #: Of each adjacent pair of symbols that may merge: rank << 44 | number of the merged symbol.
        self.pairs = {}
        for piece, rank in ranks.items():
            for i in range(1, len(piece)):
                if (left := piece[:i]) in self.number and (right := piece[i:]) in self.number:
                    self.pairs[self.number[left] << 16 | self.number[right]] = rank << 44 | self.number[piece]
        self.line_cuts = not any("\n" in x for x in self.joins)
        self.whole = _Kept(self._count_word, keep)
        self.start = _Kept(self._count_run, keep)

    @classmethod
    def from_model(cls, path: str, keep: int = 300_000) -> MergeCounter:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        by_score = sorted(plain, key=lambda i: -model.get_score(i))
        ranks, rank, last = {}, -1, None
        for i in by_score:  # equal scores share a rank: the leftmost pair is then merged first
            rank += model.get_score(i) != last
            last = model.get_score(i)
            ranks[model.id_to_piece(i)] = rank
        return cls(ranks, keep)

    def merges(self, now: list[int]) -> int:
        """How many merges the numbered symbols undergo: the adjacent pair of lowest rank is popped again and again.

        A heap entry holds rank, place and merged symbol in one number; after and before link what is left.
        """
        n, pair = len(now), self.pairs.get
        heap = [p + (i << 16) for i in range(n - 1) if (p := pair(now[i] << 16 | now[i + 1])) is not None]
        if not heap:
            return 0
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        pop, push, done = heapq.heappop, heapq.heappush, 0
        while heap:
            top = pop(heap)
            i = top >> 16 & 0xFFFFFFF
            left, j = now[i], after[i]
            if left < 0 or j >= n or pair(left << 16 | now[j]) != top - (i << 16):
                continue  # one of the two has been merged meanwhile
            made = now[i] = top & 0xFFFF
            now[j] = -1
            k = after[i] = after[j]
            done += 1
            before[k] = i
            if k < n and (p := pair(made << 16 | now[k])) is not None:
                push(heap, p + (i << 16))
            h = before[i]
            if h >= 0 and (p := pair(now[h] << 16 | made)) is not None:
                push(heap, p + (h << 16))
        return done

    def _count_run(self, run: str) -> int:
        symbols = [self.number.get(ch, -1) for ch in run]
        start = len(symbols)
        if -1 in symbols:
            start += sum(len(ch.encode()) - 1 for ch, x in zip(run, symbols) if x < 0)
            symbols = [x if x >= 0 else 0xFFFF for x in symbols]  # no pair has that number
        return start - self.merges(symbols)

    def _count_word(self, word: str) -> int:
        """Of a word that follows a space. Line breaks and an end mark that no piece joins to it are counted apart."""
        if self.line_cuts and "\n" in word:
            first, *rest = word.split("\n")
            return self.whole[first] + len(rest) * self._count_run("\n") + sum(self.start[x] for x in rest if x)
        if len(word) > 1 and word[-1] in ".," and word[-2:] not in self.joins:
            return self.whole[word[:-1]] + self._count_run(word[-1])
        return self._count_run(MARK + word)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if MARK in text:
            text = text.replace(MARK, " ")
        if text[0] == " " or "  " in text:
            return sum(self._count_run(s.replace(" ", MARK)) for s in SEGMENT.findall(" " + text))
        return sum(map(self.whole.__getitem__, text.split(" ")))


class _Kept(dict):
    """Counts by text, in two generations of which the older goes when the younger is full."""

    def __init__(self, make, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> int:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


@cache
def counter(path: str) -> MergeCounter:
    return MergeCounter.from_model(path)


def count_tokens(documents: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of documents: id, n_bytes (UTF-8), n_tokens, over_limit.

    A null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated rows give repeated rows; an
    empty table gives an empty one; other columns are not read. One pass without a shuffle.
    """
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(model_path)
        for b in batches:
            texts = b.column(1).to_pylist()
            yield batch(out, [b.column(0), [len(t.encode()) if t else 0 for t in texts], [tokens.count(t) for t in texts]])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
