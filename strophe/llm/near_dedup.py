"""Near-duplicates by fast similarity sketching, banding and verification on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, dropped, in_groups, sized, table, words
from .components import components

SKETCH = 1024  # coordinates; the first of them make the bands
BITS = SKETCH // 64  # words of one-bit coordinates
BLOCK = 512  # members of an open bucket, or of a lead, that meet in one task
SHINGLES = 1 << 18  # of all members of such a block together
ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)  # SplitMix64's constants


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(ODD[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(ODD[2])
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, of which the latest are kept."""

    most = 300_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value


def shingle_set(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of `width` words; fewer words are one shingle, none are none."""
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - width + 1)
    out = np.full(n, len(h) if len(h) < width else width, np.uint64)
    for k in range(min(width, len(h))):
        out = mixed(out * np.uint64(ODD[0]) + h[k : k + n])
    return np.unique(out)


def sketch(shingles: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketch: in each round every shingle is hashed to a bin with a value above all earlier rounds'.

    Bins take the least value. In rounds 0 to size - 1 bins are hashed; in rounds size to 2 size - 1 each round
    fills its own bin, so every coordinate is filled for any set that isn't empty. Rounds are done in blocks until
    no bin is free, which for a set of n takes about size * ln(size) / n of them.
    """
    bins = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    n, at = len(shingles), 0
    while at < 2 * size:
        upto = min(2 * size, at + max(1, -(-size * 6 // n)))
        rounds = np.arange(at, upto, dtype=np.uint64)[:, None]
        h = mixed(shingles[None, :] + (rounds + np.uint64(1)) * np.uint64(ODD[0]))
        place = np.where(rounds < size, h % np.uint64(size), rounds - np.uint64(size)).astype(np.int64)
        values = (rounds << np.uint64(52)) | (mixed(h) >> np.uint64(12))
        np.minimum.at(bins, place.ravel(), values.ravel())
        at = upto
        if bins.max() != np.iinfo(np.uint64).max:
            break
    return bins


def band_shape(percent: int) -> tuple[int, int]:
    """(bands, rows): the most rows for which 32 bands miss a pair at the threshold less often than once in 100,000."""
    j = percent / 100
    return 32, max(r for r in range(1, 20) if r == 1 or (1 - j**r) ** 32 < 1e-5)


def sketched(documents: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """Per row of documents (doc_id, text_hash, text): doc_id, text_hash, n_shingles, fingerprint of the whole set, one key
    per band, and the sketch's bits."""
    out = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("fingerprint", pa.binary()), ("keys", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        salt = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(ODD[1])
        for b in batches:
            counts, prints, keys, bits = [], [], [], []
            for text in b.column(2).to_pylist():
                s = shingle_set(text, width, hashes)
                counts.append(len(s))
                prints.append(xxhash.xxh128_digest(s.tobytes()))
                if not len(s):
                    keys.append(None), bits.append(None)
                    continue
                sk = sketch(s, SKETCH)
                key = salt.copy()
                for column in sk[: bands * rows].reshape(bands, rows).T:
                    key = mixed(key * np.uint64(ODD[0]) + column)
                keys.append(key.view(np.int64))
                bits.append(np.packbits((mixed(sk) & np.uint64(1)).astype(np.uint8)).view(np.int64))
            lists = (pa.array(x, pa.list_(pa.int64())) for x in (keys, bits))
            yield batch(out, [b.column(0), b.column(1), counts, prints, *lists])

    return documents.mapInArrow(rows_of, "doc_id long, text_hash long, n_shingles long, fingerprint binary, keys array<long>, bits array<long>")


def most_differing(percent: int) -> int:
    """In how many bits two sketches differ at most, but for about one in ten million pairs at the threshold."""
    p = (1 - percent / 100) / 2
    return int(SKETCH * (p + 5.3 * (p * (1 - p) / SKETCH) ** 0.5))


def likely(percent: int) -> Column:
    """Of a row with sizes and bits of two sets (x_n, x_bits, y_n, y_bits): sizes and bits allow the threshold."""
    differing = sum((F.bit_count(F.get("x_bits", F.lit(i)).bitwiseXOR(F.get("y_bits", F.lit(i)))) for i in range(BITS)), F.lit(0))
    return (F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * percent) & (differing <= most_differing(percent))


def texts_of(wanted: DataFrame, reps: DataFrame, documents: DataFrame) -> DataFrame:
    """(rep, text) of the representatives wanted (rep), a stored table. Their ids go to the documents where their number
    allows it, so that no other text is moved."""
    named = table(wanted.join(reps.select("rep", "doc_id", "text_hash"), "rep"), "named")
    found = documents.join(sized(named), ["doc_id", "text_hash"]).select("rep", "text").dropDuplicates(["rep"])
    return table(found, "texts")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (x, y) with 100 * intersection >= percent * union of their full shingle sets.

    Pairs are dealt by x, in parts of about BLOCK, and the text of x heads each part, once.
    """
    parts = pairs.groupBy("x").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("y"), F.col("parts")).cast("int").alias("part")
    heads = parts.select("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(texts.withColumnRenamed("rep", "x"), "x").select("x", "part", F.lit(0).alias("follows"), F.col("x").alias("y"), "text")
    rest = pairs.join(parts, "x").select("x", part, "y").join(texts.withColumnRenamed("rep", "y"), "y").select("x", "part", F.lit(1).alias("follows"), "y", "text")
    rows = heads.unionByName(rest).repartition("x", "part").sortWithinPartitions("x", "part", "follows")
    out = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, head, own = WordHashes(), None, np.empty(0, np.uint64)
        for b in batches:
            found = []
            for x, follows, y, text in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4))):
                s = shingle_set(text, width, hashes)
                if not follows:
                    head, own = x, s
                elif x == head:
                    both = len(np.intersect1d(s, own, assume_unique=True))
                    if 100 * both >= percent * (len(s) + len(own) - both):
                        found.append((x, y))
            yield batch(out, [list(c) for c in zip(*found)] or [[], []])

    return rows.mapInArrow(compared, "x long, y long")


def in_blocks(members: DataFrame, sizes: str, columns: list[str]) -> DataFrame:
    """Members (key, outside, rep, ...) dealt to groups (key, block, other): each block of a key's members with each block of
    those outside its largest component. `other` rows (probe = 1) are of those outside. No group holds more than about BLOCK members
    of either kind, or SHINGLES shingles by the column `sizes`."""
    pieces = lambda of, which: F.greatest(F.lit(1), F.ceil(F.sum(F.when(which, 1)) / BLOCK), F.ceil(F.sum(F.when(which, F.col(of))) / SHINGLES)).cast("int")
    of = members.groupBy("key").agg(pieces(sizes, F.lit(True)).alias("blocks"), pieces(sizes, F.col("outside")).alias("others"), F.count_if("outside").alias("n_out")).where("n_out > 0").drop("n_out")
    placed = members.join(of, "key")
    at = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    whole = placed.select("key", at("blocks").alias("block"), F.explode(every("others")).alias("other"), F.lit(0).alias("probe"), *columns)
    outside = placed.where("outside").select("key", F.explode(every("blocks")).alias("block"), at("others").alias("other"), F.lit(1).alias("probe"), *columns)
    return whole.unionByName(outside).repartition("key", "block", "other").sortWithinPartitions("key", "block", "other")


def sides(group: pa.Table) -> tuple[pa.Table, pa.Table]:
    """The probes and the block of a group of in_blocks()."""
    probe = group.column("probe").to_numpy() == 1
    return group.filter(pa.array(probe)), group.filter(pa.array(~probe))


def lists(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def worth_comparing(members: DataFrame, percent: int, bands: int) -> DataFrame:
    """(key, rep) of the members (key, outside, rep, component, n, bits, keys) of open buckets that are in a likely pair between components, of which one is outside the largest.

    A pair counts in the first bucket that it shares only. Sketches meet within a task; what leaves it are members, not pairs.
    """
    most = most_differing(percent)
    out = pa.schema([("key", pa.int64()), ("rep", pa.int64())])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in in_groups(batches, 3):
            p, q = sides(group)
            if not p.num_rows or not q.num_rows:
                continue
            prep, qrep, pc, qc, pn, qn = (t.column(c).to_numpy() for c in ("rep", "component", "n") for t in (p, q))
            fine = (pc[:, None] != qc[None, :]) & (np.minimum(pn[:, None], qn[None, :]) * 100 >= np.maximum(pn[:, None], qn[None, :]) * percent)
            if not fine.any():
                continue
            pb, qb = lists(p.column("bits"), BITS), lists(q.column("bits"), BITS)
            differ = np.zeros(fine.shape, np.int16)
            for k in range(BITS):
                differ += np.bitwise_count(pb[:, None, k] ^ qb[None, :, k])
            i, j = np.nonzero(fine & (differ <= most))
            if not len(i):
                continue
            pk, qk = lists(p.column("keys"), bands), lists(q.column("keys"), bands)
            key, hot = group.column("key")[0].as_py(), np.zeros(len(i), bool)
            for at in range(0, len(i), 8192):
                some = slice(at, at + 8192)
                same = pk[i[some]] == qk[j[some]]
                hot[some] = pk[i[some], same.argmax(axis=1)] == key
            found = np.union1d(prep[i[hot]], qrep[j[hot]])
            if len(found):
                yield batch(out, [pa.array(np.full(len(found), key)), pa.array(found)])

    columns = ["rep", "component", "n", "bits", "keys"]
    return in_blocks(members, "one", columns).mapInArrow(met, "key long, rep long").distinct()


def shared_sizes(p: list[np.ndarray], q: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each set of p with each of q, by products of incidence matrices, `columns` shingles at a time."""
    both = np.zeros((len(p), len(q)), np.int64)
    kinds = np.intersect1d(np.unique(np.concatenate(p)), np.unique(np.concatenate(q)), assume_unique=True)
    rows = lambda sets: np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    pr, qr, pv, qv = rows(p), rows(q), np.concatenate(p), np.concatenate(q)
    place = lambda v: np.searchsorted(kinds, v).clip(max=max(0, len(kinds) - 1))
    if not len(kinds):
        return both
    pp, qp = place(pv), place(qv)
    pok, qok = kinds[pp] == pv, kinds[qp] == qv
    pr, pp, qr, qp = pr[pok], pp[pok], qr[qok], qp[qok]
    for at in range(0, len(kinds), columns):
        n = min(columns, len(kinds) - at)
        a, b = np.zeros((len(p), n), np.float32), np.zeros((len(q), n), np.float32)
        i, j = (pp >= at) & (pp < at + n), (qp >= at) & (qp < at + n)
        a[pr[i], pp[i] - at] = 1
        b[qr[j], qp[j] - at] = 1
        both += (a @ b.T).astype(np.int64)
    return both


def linked_in_blocks(members: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (x, y) between components of members (key, outside, rep, component, n, text) of open buckets: of all pairs of full sets
    that meet the threshold, in each task as many as join the same components."""
    out = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for group in in_groups(batches, 3):
            p, q = sides(group)
            if not p.num_rows or not q.num_rows:
                continue
            prep, qrep, pc, qc = (t.column(c).to_numpy() for c in ("rep", "component") for t in (p, q))
            if len(np.union1d(pc, qc)) < 2:
                continue
            ps, qs = ([shingle_set(x, width, hashes) for x in t.column("text").to_pylist()] for t in (p, q))
            both = shared_sizes(ps, qs)
            union = np.array([len(s) for s in ps])[:, None] + np.array([len(s) for s in qs])[None, :] - both
            i, j = np.nonzero((100 * both >= percent * union) & (pc[:, None] != qc[None, :]))
            above: dict[int, int] = {}

            def top(c: int) -> int:
                while c in above:
                    c = above[c]
                return c

            found = []
            for a, b in zip(i.tolist(), j.tolist()):
                x, y = top(int(pc[a])), top(int(qc[b]))
                if x != y:
                    above[max(x, y)] = min(x, y)
                    found.append((int(max(prep[a], qrep[b])), int(min(prep[a], qrep[b]))))
            if found:
                yield batch(out, [list(c) for c in zip(*found)])

    return in_blocks(members, "n", ["rep", "component", "text"]).mapInArrow(met, "x long, y long")


def classes_of(known: DataFrame) -> DataFrame:
    """One row per set among rows of sketched() that have an id and a word: fingerprint, rep, doc_id, text_hash, n, keys, bits.

    doc_id and text_hash name the row that stands for the class, with the smallest id. rep is that id too, and another number
    where rows of one id would stand for several classes.
    """
    own = known.where("doc_id IS NOT NULL AND n_shingles > 0")
    reps = own.groupBy("fingerprint").agg(F.min(F.struct("doc_id", "text_hash", "n_shingles", "keys", "bits")).alias("s"))
    reps = table(reps.select("fingerprint", "s.doc_id", "s.text_hash", F.col("s.n_shingles").alias("n"), "s.keys", "s.bits"), "classes")
    again = table(reps.groupBy("doc_id").agg(F.count("*").alias("of"), F.min("fingerprint").alias("first")).where("of > 1").select("doc_id", "first"), "again")
    if again.isEmpty():
        return reps.withColumn("rep", F.col("doc_id"))
    other = F.xxhash64("fingerprint").bitwiseAND((1 << 62) - 1) + (1 << 62)
    told = reps.join(again, "doc_id", "left").withColumn("rep", F.when(F.col("first").isNull() | (F.col("first") == F.col("fingerprint")), F.col("doc_id")).otherwise(other))
    return told.drop("first")


def grouped(documents: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of documents: doc_id, text_hash (xxhash64 of the text), n_shingles, group, component_id.

    group numbers the component that a row's own set belongs to, null without a set or an id; component_id is the smallest id
    in it, or the row's id where group is null. See near_duplicates().
    """
    bands, rows = band_shape(percent)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    known = table(sketched(docs, width, bands, rows), "sketches")
    reps = classes_of(known)
    members = reps.select(F.explode("keys").alias("key"), "rep")
    shared = members.groupBy("key").agg(F.count("*").alias("of")).where("of > 1")
    live = table(members.join(shared, "key"), "live")
    marks = table(reps.select("rep", "n", "bits").join(live.groupBy("rep").agg(F.sum("of").alias("central")), "rep"), "marks")

    central = F.max(F.struct(F.col("central"), (-F.col("rep")).alias("minus"))).alias("lead")
    leads = live.join(marks.select("rep", "central"), "rep").groupBy("key").agg(central).select("key", (-F.col("lead.minus")).alias("lead"))
    star = live.join(leads, "key").where("rep <> lead").select(F.col("lead").alias("x"), F.col("rep").alias("y")).distinct()
    as_x, as_y = (marks.select(*(F.col(c).alias(f"{p}_{c}") for c in ("rep", "n", "bits"))).withColumnRenamed(f"{p}_rep", p) for p in "xy")
    star = table(star.join(as_x, "x").join(as_y, "y").where(likely(percent)).select("x", "y"), "pairs")
    texts = texts_of(table(star.select("x").union(star.select("y")).distinct().toDF("rep"), "wanted"), reps, docs)
    links = table(verified(star, texts, width, percent), "links")
    dropped(texts, star)

    labels = lambda links: table(components(links, "x", "y").select(F.col("id").alias("rep"), "component"), "labels")
    found = labels(links)
    labelled = live.join(found, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    shares = labelled.groupBy("key", "component").agg(F.count("*").alias("of"))
    several = shares.groupBy("key").agg(F.count("*").alias("several"), F.max(F.struct("of", "component")).alias("most")).where("several > 1").select("key", F.col("most.component").alias("largest"))
    open_ = table(labelled.join(several, "key").select("key", "rep", "component", (F.col("component") != F.col("largest")).alias("outside")), "open")
    dropped(live, marks)
    if not open_.isEmpty():
        near = table(worth_comparing(open_.join(reps.select("rep", "n", "bits", "keys"), "rep").withColumn("one", F.lit(1)), percent, bands), "near")
        texts = texts_of(table(near.select("rep").distinct(), "wanted"), reps, docs)
        both = near.join(open_, ["key", "rep"]).join(reps.select("rep", "n"), "rep").join(texts, "rep")
        more = table(linked_in_blocks(both, width, percent), "more")
        if not more.isEmpty():
            found = labels(links.union(more))
        dropped(texts, near)
    dropped(open_)

    classes = reps.select("fingerprint", "rep", "doc_id").join(found, "rep", "left").select("fingerprint", "doc_id", F.coalesce("component", "rep").alias("group"))
    least = classes.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    classes = classes.select("fingerprint", "group").join(least, "group")
    rows_ = known.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("fingerprint")).alias("fingerprint"))
    return rows_.join(classes, "fingerprint", "left").select("doc_id", "text_hash", "n_shingles", "group", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of documents: doc_id, n_shingles, component_id, kept.

    Documents whose sets of `width`-word shingles have 100 * intersection >= percent * union are linked;
    component_id is the smallest id that links reach, and kept says that it is the row's own. A text that is null or without
    words has no shingle and no link, nor has a row of null id; each is kept. Rows that repeat an id are documents of their own,
    each with its own set; equal rows have equal results. Texts of any length are read whole; an empty table gives no
    rows; other columns, whatever their names, aren't looked at.

    Equal sets are one class with one representative. Representatives are banded; what shares no bucket is done with.
    In each bucket all are compared with its most central member, which shares the most buckets' worth of others, so a
    group of any number of copies costs a pair each. In buckets that still hold several components, members outside
    the largest are met with those of other components (a pair within one would add nothing): first sketches, then
    the full sets of those in a likely pair, both in blocks of one task each, from which members and joining links come, never
    pairs. Sizes and sketch bits only rule out; full sets decide.
    """
    found = grouped(documents, width, percent, id_col, text_col)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
