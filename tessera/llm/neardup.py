"""Near-duplicate records by token-combination prefixes.

A record is the set of its word shingles (hashed to 64 bits). Records with the same set are one
class; the join runs between classes, their members are attached afterwards.

Method. All shingles have one global order, rarest first. If two sets have a Jaccard similarity of
at least t, their prefixes of |x| - ceil(t |x|) + k shingles share at least k shingles; k is 2 and one
more for every 32 shingles of the smaller set. Shingles are rare or frequent by a count sketch over
all records. The index holds each rare shingle of a prefix singly and each combination of two
frequent ones; a similar pair shares s singles and f frequent ones with s + f >= k, so at least
k - 1 keys. Pairs that share so many and pass the length filter and a parity bitmap (the symmetric
difference is at least the distance of the bitmaps) have their sets compared. A shingle that the
sketch counts once is in one class only and needs no key. A key with more than ``HOT`` classes is
split into blocks of about so many; each two blocks meet in a task of their own, so no key is a hot
one. No bound is set on partners or candidates, and no link is lost.

The sketch has a fixed number of cells; its size, not the data's, is what the driver gathers and
broadcasts. It only decides the order and the classes, so too few cells cost time, never links.

Sets so small that similar ones may share fewer than k shingles (at 0.7 those of one shingle, at 0.5
of up to two), and all sets that can be similar to them, have every shingle as a key as well. The
threshold must be at least 0.1, so that these sets are small ones.

Defined results: records with a null key or text or with fewer than ``least_words`` words take no
part; a record delivered again counts once; equal texts are linked; a pair is given once, the
smaller key first. Columns other than key and text are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import sketch as S
from tessera.session import cut

_WORD = re.compile(r"[^\W_]+")
RARE = 24  # a shingle is rare up to so many occurrences above the mean load of the sketch's cells
HOT = 2000  # classes under one key that meet in one task; more are split into blocks
STEP = 32  # a similar pair must share one key more for every so many shingles of the smaller set
BUCKETS = 1 << 20  # bits of the filter that spares the comparison step most of the texts
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) >= 500_000:
            self.clear()
        self[word] = value
        return value


_WORDS = _WordHash()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    x = (x ^ (x >> np.uint64(29))) * _M3
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str | None], width: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions of the texts that take part, offsets, sorted distinct shingle hashes of one after the other)."""
    words = [_WORD.findall(t.lower()) if t else () for t in texts]
    least = max(least_words, width)
    kept = np.array([i for i, w in enumerate(words) if len(w) >= least], dtype=np.int64)
    if not len(kept):
        return kept, np.zeros(1, np.int64), np.zeros(0, np.uint64)
    lengths = np.array([len(words[i]) for i in kept], dtype=np.int64)
    flat = np.fromiter(map(_WORDS.__getitem__, chain.from_iterable(words[i] for i in kept)), dtype=np.uint64, count=int(lengths.sum()))
    owner = np.repeat(np.arange(len(kept)), lengths)
    n = len(flat) - width + 1
    mixed = flat[:n].copy()
    for k in range(1, width):
        mixed = _mix(mixed * _M1 + flat[k : k + n])
    inside = owner[:n] == owner[width - 1 :]
    mixed, owner = _mix(mixed)[inside], owner[:n][inside]
    order = np.lexsort((mixed, owner))
    mixed, owner = mixed[order], owner[order]
    first = np.ones(len(mixed), dtype=bool)
    first[1:] = (mixed[1:] != mixed[:-1]) | (owner[1:] != owner[:-1])
    mixed, owner = mixed[first], owner[first]
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(kept)))))
    return kept, offsets, mixed


def class_ids(offsets: np.ndarray, shingles: np.ndarray) -> list[int]:
    """64 bits for each set; with n classes the odds of any two falling together are below n² / 2^65."""
    return [
        int.from_bytes(hashlib.blake2b(shingles[a:b].tobytes(), digest_size=8).digest(), "little", signed=True)
        for a, b in zip(offsets[:-1], offsets[1:])
    ]


def parity_bitmaps(offsets: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words for each set: bit j is the parity of the number of shingles that hash to j."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    bits = np.bincount(owner * 128 + (shingles >> np.uint64(57)).astype(np.int64), minlength=n * 128) & 1
    words = np.packbits(bits.reshape(n, 128).astype(np.uint8), axis=1).view(np.int64)
    return words[:, 0].copy(), words[:, 1].copy()


@cache
def small_sets(threshold: float) -> int:
    """The largest size of a set to which a similar one may have fewer than k shingles in common."""
    return max((n for n in range(1, 200) if math.ceil(threshold * n - 1e-9) < 2 + n // STEP), default=0)


def prefix_keys(shingles: np.ndarray, counts: np.ndarray, rare: int, threshold: float) -> np.ndarray:
    """Index keys of one set: rare shingles of its extended prefix, pairs of frequent ones."""
    n = len(shingles)
    k = 2 + n // STEP
    need = math.ceil(threshold * n - 1e-9)
    every = shingles[:0]
    if n * threshold <= small_sets(threshold):
        every = shingles[counts > 1]
        if need < k:
            return every
    length = min(n, n - need + k)
    order = np.lexsort((shingles, counts))[:length]
    prefix, frequency = shingles[order], counts[order]
    n_rare = int(np.searchsorted(frequency, rare, side="right"))
    singles = prefix[:n_rare][frequency[:n_rare] > 1]
    if len(every):
        singles = np.union1d(singles, every)
    if length - n_rare < 2:
        return singles
    often = np.sort(prefix[n_rare:])
    i, j = np.triu_indices(len(often), 1)
    return np.concatenate((singles, _mix(often[i] * _M1 + often[j])))


def _members(key: str, text: str, width: int, least_words: int, cells: int):
    """Rows (key, cls, n) of all records, and this task's sketch in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(cells, dtype=np.int64)
        names = ["key", "cls", "n", "slice", "counts"]
        seen: set[int] = set()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            kept, offsets, shingles = shingle_sets(batch.column(1).to_pylist(), width, least_words)
            classes = class_ids(offsets, shingles)
            new = np.array([not (c in seen or seen.add(c)) for c in classes], dtype=bool)
            if len(seen) > 500_000:
                seen.clear()
            if len(classes):
                lengths = np.diff(offsets)
                counted = shingles[np.repeat(new, lengths)]
                sketch += np.bincount((counted & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([keys[i] for i in kept], pa.string()),
                        pa.array(classes, pa.int64()),
                        pa.array(lengths, pa.int32()),
                        pa.nulls(len(kept), pa.int32()),
                        pa.nulls(len(kept), pa.binary()),
                    ],
                    names=names,
                )
        for number, blob in S.slices(sketch):
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([number], pa.int32()), pa.array([blob], pa.binary())], names=names
            )

    return run


def _keys(width: int, least_words: int, threshold: float, cells: int, sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        rare = int(counts.mean()) + RARE
        seen: set[int] = set()
        for batch in batches:
            _, offsets, shingles = shingle_sets(batch.column(1).to_pylist(), width, least_words)
            if len(offsets) < 2:
                continue
            classes = class_ids(offsets, shingles)
            high, low = parity_bitmaps(offsets, shingles)
            frequency = counts[(shingles & np.uint64(cells - 1)).astype(np.int64)]
            parts, owners = [], []
            for i, c in enumerate(classes):
                if c in seen:
                    continue
                seen.add(c)
                a, b = offsets[i], offsets[i + 1]
                parts.append(prefix_keys(shingles[a:b], frequency[a:b], rare, threshold))
                owners.append(i)
            if len(seen) > 500_000:
                seen.clear()
            if not parts:
                continue
            lengths = np.array([len(p) for p in parts])
            owner = np.repeat(np.array(owners, dtype=np.int64), lengths)
            n = np.diff(offsets).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(parts).view(np.int64)),
                    pa.array(np.array(classes, dtype=np.int64)[owner]),
                    pa.array(n[owner]),
                    pa.array(high[owner]),
                    pa.array(low[owner]),
                ],
                names=["index_key", "cls", "n", "high", "low"],
            )

    return run


def _sets(width: int, least_words: int, wanted):
    """Shingle sets of the texts whose key falls in a wanted bucket; texts beside those cost no shingling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            batch = batch.filter(pa.array(bits[batch.column(1).to_numpy(zero_copy_only=False)]))
            _, offsets, shingles = shingle_sets(batch.column(0).to_pylist(), width, least_words)
            blobs = [shingles[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(class_ids(offsets, shingles), pa.int64()), pa.array(blobs, pa.binary())], names=["cls", "shingles"])

    return run


def _verify(numerator: int, denominator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, same = [], [], []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("cls_a", "cls_b", "shingles_a", "shingles_b"))):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate((p, q)))
                overlap = int((both[1:] == both[:-1]).sum())
                union = len(both) - overlap
                if overlap * denominator >= numerator * union:
                    left.append(a)
                    right.append(b)
                    same.append(overlap / union)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(same, pa.float64())], names=["cls_a", "cls_b", "similarity"])

    return run


_MET = "index_key long, cls_a long, cls_b long, n int, high long, low long"
_ROW = ("index_key", "cls", "n", "high", "low")


def _near_enough(threshold: float, n_a, n_b, distance):
    """Length and bitmap filters: whether sets of these sizes can be similar with bitmaps so far apart."""
    total = n_a + n_b
    least_overlap = np.ceil(total * (threshold / (1 + threshold)) - 1e-9)
    return (np.minimum(n_a, n_b) >= np.maximum(n_a, n_b) * threshold - 1e-9) & (distance <= total - 2 * least_overlap)


def _meet(threshold: float, hot: int):
    """Pairs of classes under a key out of rows sorted by key and class; the rows of keys with more than ``hot`` classes go on as they are."""
    names = [part.split()[0] for part in _MET.split(", ")]

    def pairs_of(rows: tuple[np.ndarray, ...], starts: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, cls, n, high, low = rows
        high, low = high.view(np.uint64), low.view(np.uint64)  # of a negative number the bits of its absolute value would be counted
        for m in np.unique(lengths):
            i, j = np.triu_indices(int(m), 1)
            at = starts[lengths == m]
            step = max(1, 2_000_000 // len(i))
            for k in range(0, len(at), step):
                left, right = (at[k : k + step, None] + i).ravel(), (at[k : k + step, None] + j).ravel()
                distance = np.bitwise_count(high[left] ^ high[right]).astype(np.int64) + np.bitwise_count(low[left] ^ low[right])
                near = _near_enough(threshold, n[left], n[right], distance)
                left, right = left[near], right[near]
                if len(left):
                    empty = pa.nulls(len(left), pa.int64())
                    yield pa.RecordBatch.from_arrays([empty, pa.array(cls[left]), pa.array(cls[right]), pa.array(np.minimum(n[left], n[right])), empty, empty], names=names)

    def as_they_are(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        key, cls, n, high, low = map(pa.array, rows)
        return pa.RecordBatch.from_arrays([key, cls, pa.nulls(len(key), pa.int64()), n, high, low], names=names)

    def runs(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        key = rows[0]
        starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
        lengths = np.diff(np.append(starts, len(key)))
        some = (lengths > 1) & (lengths <= hot)
        yield from pairs_of(rows, starts[some], lengths[some])
        many = np.repeat(lengths > hot, lengths)
        if many.any():
            yield as_they_are(tuple(c[many] for c in rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple[np.ndarray, ...] | None = None  # the last key's rows, which may go on in the next batch
        flowing: tuple[int, int] | None = None  # a key known to be hot, and its last class
        for batch in batches:
            rows = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in _ROW)
            if waiting is not None:
                rows = tuple(np.concatenate(pair) for pair in zip(waiting, rows))
                waiting = None
            key, cls = rows[:2]
            if not len(key):
                continue
            fresh = np.ones(len(key), dtype=bool)
            fresh[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
            if flowing is not None:
                fresh[0] = (int(key[0]), int(cls[0])) != flowing
            rows = tuple(c[fresh] for c in rows)
            if flowing is not None:
                same = rows[0] == flowing[0]
                if same.any():
                    yield as_they_are(tuple(c[same] for c in rows))
                    flowing = (flowing[0], int(rows[1][same][-1]))
                rows = tuple(c[~same] for c in rows)
                if not len(rows[0]):
                    continue
                flowing = None
            last = int((rows[0] != rows[0][-1]).sum())
            if last:
                yield from runs(tuple(c[:last] for c in rows))
            tail = tuple(c[last:] for c in rows)
            if len(tail[0]) > hot:
                yield as_they_are(tail)
                flowing = (int(tail[0][-1]), int(tail[1][-1]))
            else:
                waiting = tail
        if waiting is not None and len(waiting[0]):
            yield from runs(waiting)

    return run


def _meeting(keys: DataFrame, threshold: float, hot: int) -> DataFrame:
    """(cls_a, cls_b, n) of each two classes that may be similar, once for each key that both have; ``keys`` are partitioned by key."""
    met = cut(keys.sortWithinPartitions("index_key", "cls").mapInArrow(_meet(threshold, hot), _MET))
    columns = ("cls", "n", "high", "low")
    many = met.where("cls_b is null").select("index_key", F.col("cls_a").alias("cls"), "n", "high", "low")
    sizes = many.groupBy("index_key").agg(F.count("*").alias("m"))
    many = many.join(sizes, "index_key").withColumn("blocks", F.ceil(F.col("m") / hot)).withColumn("last", (F.col("blocks") - 1).cast("int"))
    many = many.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    left = many.select("index_key", F.col("block").alias("one"), F.explode(F.sequence("block", "last")).alias("two"), *columns)
    right = many.select("index_key", F.explode(F.sequence(F.lit(0), "block")).alias("one"), F.col("block").alias("two"), *(F.col(c).alias(f"{c}_b") for c in columns))
    split = left.join(right, ["index_key", "one", "two"]).where((F.col("one") < F.col("two")) | (F.col("cls") < F.col("cls_b")))
    total = F.col("n") + F.col("n_b")
    least_overlap = F.ceil(total * F.lit(threshold / (1 + threshold)) - F.lit(1e-9))
    distance = F.bit_count(F.col("high").bitwiseXOR(F.col("high_b"))) + F.bit_count(F.col("low").bitwiseXOR(F.col("low_b")))
    near = split.where(F.least("n", "n_b") >= F.greatest("n", "n_b") * F.lit(threshold) - F.lit(1e-9)).where(distance <= total - 2 * least_overlap)
    hot_pairs = near.select(F.least("cls", "cls_b").alias("cls_a"), F.greatest("cls", "cls_b").alias("cls_b"), F.least("n", "n_b").alias("n"))
    return met.where("cls_b is not null").select("cls_a", "cls_b", "n").unionByName(hot_pairs)


def similar_classes(
    records: DataFrame,
    key: str,
    text: str,
    threshold: float = 0.8,
    width: int = 5,
    least_words: int = 5,
    cells: int = 1 << 22,
    hot: int = HOT,
) -> tuple[DataFrame, DataFrame]:
    """(members: key, cls, n) and (links: cls_a, cls_b, similarity) of all records and all similar classes."""
    if not 0.1 <= threshold <= 1:
        raise ValueError("the threshold must be between 0.1 and 1")
    spark = records.sparkSession
    narrow = records.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")
    gathered = cut(narrow.mapInArrow(_members("key", "text", width, least_words, cells), "key string, cls long, n int, slice int, counts binary"))
    members = gathered.where("key is not null").select("key", "cls", "n").distinct()
    sketch = S.gather(gathered.where("slice is not null").select("slice", "counts"), cells)
    shared = spark.sparkContext.broadcast(sketch)

    keys = narrow.mapInArrow(
        _keys(width, least_words, threshold, cells, shared), "index_key long, cls long, n int, high long, low long"
    ).repartition("index_key")
    candidates = (
        _meeting(keys, threshold, hot)
        .groupBy("cls_a", "cls_b")
        .agg(F.count("*").alias("n_keys"), F.min("n").alias("n"))
        .where(F.col("n_keys") >= 1 + F.floor(F.col("n") / STEP))
        .select("cls_a", "cls_b")
    )
    candidates = cut(candidates)
    representatives = members.groupBy("cls").agg(F.min("key").alias("key"))
    involved = candidates.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct()
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS))
    wanted = involved.join(representatives, "cls").select(bucket.alias("bucket"))
    words = wanted.groupBy(F.floor(F.col("bucket") / 32).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(bucket, 32) as int)))").alias("bits"))
    bits = np.zeros(BUCKETS, dtype=bool)
    for word, held in words.collect():  # BUCKETS / 32 rows at most, whatever the data
        bits[word * 32 : word * 32 + 32] = (held >> np.arange(32)) & 1
    sets = (
        narrow.select("text", bucket.alias("bucket"))
        .mapInArrow(_sets(width, least_words, spark.sparkContext.broadcast(bits)), "cls long, shingles binary")
        .groupBy("cls")
        .agg(F.first("shingles").alias("shingles"))
    )
    numerator, denominator = (round(threshold * 1000), 1000)
    links = (
        candidates.join(sets.select(F.col("cls").alias("cls_a"), F.col("shingles").alias("shingles_a")), "cls_a")
        .join(sets.select(F.col("cls").alias("cls_b"), F.col("shingles").alias("shingles_b")), "cls_b")
        .mapInArrow(_verify(numerator, denominator), "cls_a long, cls_b long, similarity double")
    )
    return members, links


def similar_pairs(members: DataFrame, links: DataFrame, several_texts: bool = False) -> DataFrame:
    """(key_a, key_b) of all linked records: those of one class and those of similar classes.

    Where a key may have come with several texts, ``several_texts`` gives its pairs once.
    """
    a = members.select(F.col("cls").alias("cls_a"), F.col("key").alias("x"))
    b = members.select(F.col("cls").alias("cls_b"), F.col("key").alias("y"))
    within = a.join(b, F.col("cls_a") == F.col("cls_b")).where("x < y").select("x", "y")
    across = links.select("cls_a", "cls_b").join(a, "cls_a").join(b, "cls_b").select("x", "y")
    pairs = within.unionByName(across.where("x <> y")).select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))
    return pairs.distinct() if several_texts else pairs


def class_table(members: DataFrame, links: DataFrame) -> DataFrame:
    """(key, class_id, class_size, n_links) of every record; n_links counts linked records of other classes."""
    sizes = members.groupBy("cls").agg(F.min("key").alias("class_id"), F.count("*").alias("class_size"))
    both = links.select(F.col("cls_a").alias("cls"), F.col("cls_b").alias("other")).unionByName(
        links.select(F.col("cls_b").alias("cls"), F.col("cls_a").alias("other"))
    )
    linked = both.join(sizes.select(F.col("cls").alias("other"), "class_size"), "other").groupBy("cls").agg(F.sum("class_size").alias("n_links"))
    return (
        members.join(sizes, "cls").join(linked, "cls", "left").select("key", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
