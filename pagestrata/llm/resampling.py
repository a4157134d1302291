"""Importance resampling towards the benchmark's distribution of hashed n-grams.

Texts of an Arrow batch become one byte buffer; its words are found by byte tables, its n-grams interned in an
open-addressed NumPy table: keys are XXH64 values, a hit is verified byte by byte, a clash goes on to the next place. Every
slot holds the bucket of its n-gram and how often the batch has it. The first pass adds slots up to bucket counts; the
second looks a gain up per slot and gathers it to the occurrences through their slot numbers. What reaches the driver are
the counts of the buckets, as many as ``BUCKETS`` says. Draws are ranked by ranges, never in one task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.llm import base

BUCKETS = 10_000
#: N-grams from LEAST to MOST words.
LEAST, MOST = 1, 1
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Occurrences interned at once.
CHUNK = 1 << 19
#: Rows and bytes of text in one Arrow batch.
BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IN_WORD = np.array([c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 for c in range(256)])
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of the slices of a byte array, which must have 8 spare bytes at its end."""
    out = size.astype(np.uint64) + _P5
    long = np.flatnonzero(size >= 32)
    lanes = np.lib.stride_tricks.sliding_window_view(data, 8)
    with np.errstate(over="ignore"):
        at, left = start.copy(), np.where(size < 32, size, 0)
        for _ in range(3):
            k = np.flatnonzero(left >= 8)
            if not len(k):
                break
            lane = np.ascontiguousarray(lanes[at[k]]).view("<u8").ravel()
            out[k] = _rotl(out[k] ^ (_rotl(lane * _P2, 31) * _P1), 27) * _P1 + _P4
            at[k] += 8
            left[k] -= 8
        k = np.flatnonzero(left >= 4)
        lane = np.ascontiguousarray(lanes[at[k]][:, :4]).view("<u4").ravel().astype(np.uint64)
        out[k] = _rotl(out[k] ^ (lane * _P1), 23) * _P2 + _P3
        at[k] += 4
        left[k] -= 4
        for _ in range(3):
            k = np.flatnonzero(left > 0)
            out[k] = _rotl(out[k] ^ (data[at[k]].astype(np.uint64) * _P5), 11) * _P1
            at[k] += 1
            left[k] -= 1
        out ^= out >> np.uint64(33)
        out *= _P2
        out ^= out >> np.uint64(29)
        out *= _P3
        out ^= out >> np.uint64(32)
    for k in long:
        out[k] = xxhash.xxh64_intdigest(data[start[k] : start[k] + size[k]])
    return out


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the slices of ``size`` bytes at ``a`` and at ``b`` are equal."""
    equal = np.ones(len(a), bool)
    lanes = np.lib.stride_tricks.sliding_window_view(data, 8)
    for at in range(0, min(int(size.max(initial=0)), 64), 8):
        k = np.flatnonzero(equal & (size > at))
        x = np.ascontiguousarray(lanes[a[k] + at]).view("<u8").ravel() ^ np.ascontiguousarray(lanes[b[k] + at]).view("<u8").ravel()
        spare = np.maximum(8 - (size[k] - at), 0).astype(np.uint64) * np.uint64(8)
        equal[k] = (x << spare) == 0
    for k in np.flatnonzero(equal & (size > 64)):
        equal[k] = bool((data[a[k] + 64 : a[k] + size[k]] == data[b[k] + 64 : b[k] + size[k]]).all())
    return equal


def interned(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot of every occurrence, occurrence that stands for every slot) of an open-addressed table.

    Free places are claimed by any of the occurrences that reach them, the others compare keys and bytes with the owner and move on
    by one when they differ.
    """
    places = 1 << max(4, (2 * len(start) - 1).bit_length())
    key = hashes(data, start, size)
    owner = np.full(places, -1, np.int64)
    at = (key & np.uint64(places - 1)).astype(np.int64)
    waiting = np.arange(len(start))
    while len(waiting):
        spot = at[waiting]
        free = owner[spot] < 0
        owner[spot[free]] = waiting[free]
        held = owner[spot]
        same = (key[held] == key[waiting]) & (size[held] == size[waiting])
        k = np.flatnonzero(same)
        same[k] = same_bytes(data, start[held[k]], start[waiting[k]], size[waiting[k]])
        waiting = waiting[~same]
        at[waiting] = (at[waiting] + 1) & (places - 1)
    used = np.flatnonzero(owner >= 0)
    number = np.empty(places, np.int64)
    number[used] = np.arange(len(used))
    return number[at], owner[used]


class Grams:
    """The n-grams of a batch of texts, in one buffer with single spaces between words."""

    def __init__(self, texts: pa.Array, least: int, most: int, buckets: int):
        self.least, self.most, self.buckets = least, most, buckets
        parts = [b"" if t is None else t.translate(_LOWER) for t in texts.cast(pa.binary()).to_pylist()]
        ends = np.cumsum([len(p) + 1 for p in parts])
        raw = np.frombuffer(b"\0".join([*parts, b""]), np.uint8)  # a NUL after every text
        inside = _IN_WORD[raw]
        first = inside & ~np.concatenate(([False], inside[:-1]))
        start = np.flatnonzero(first)
        stop = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False]))) + 1
        keep = inside.copy()
        keep[stop] = True  # one separator after every word
        data = raw[keep]
        data[~inside[keep]] = 32
        new = np.cumsum(keep) - 1
        self.start, self.stop = new[start], new[stop - 1] + 1
        self.data = np.concatenate((data, np.zeros(16, np.uint8)))
        self.doc = np.searchsorted(ends, start, side="right")
        self.words = np.bincount(self.doc, minlength=len(parts)).astype(np.int64)

    def slots(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each chunk of occurrences: their documents, their slots, and bucket and count of every slot."""
        for n in range(self.least, self.most + 1):
            last = len(self.start) - n + 1
            for a in range(0, max(last, 0), CHUNK):
                i = np.arange(a, min(a + CHUNK, last))
                i = i[self.doc[i] == self.doc[i + n - 1]]
                start, size = self.start[i], self.stop[i + n - 1] - self.start[i]
                slot, of = interned(self.data, start, size)
                view = self.data.data
                bucket = np.fromiter((zlib.crc32(view[x : x + y]) % self.buckets for x, y in zip(start[of].tolist(), size[of].tolist())), np.int64, len(of))
                yield self.doc[i], slot, bucket, np.bincount(slot, minlength=len(of))

    def features(self) -> np.ndarray:
        return sum(np.maximum(self.words - n + 1, 0) for n in range(self.least, self.most + 1))


def _batches(texts: DataFrame) -> DataFrame:
    conf = texts.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return texts


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, least: int = LEAST, most: int = MOST) -> np.ndarray:
    """How many n-grams of all texts fall into each bucket. A task sends its counts once, as one row a bucket."""

    def task(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, bucket, count in Grams(batch.column(0), least, most, buckets).slots():
                np.add.at(total, bucket, count)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["bucket", "n"])

    counted = _batches(docs.select("text")).mapInArrow(task, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for row in counted.collect():  # at most one row a bucket
        total[row.bucket] = row.n
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of the target's share to the source's, with one added to every bucket."""
    n, whole_s, whole_t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (whole_s + n) / ((s + 1.0) * (whole_t + n)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(seed: int = SEED) -> Column:
    """Gumbel noise in floored thousandths from the first 32 bits of sha256(``seed:doc_id``)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weighed(docs: DataFrame, gain: np.ndarray, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of every text's n-grams, 0 where there are none."""
    schema = "doc_id long, n_words long, n_features long, weight long"

    def task(batches):
        for batch in batches:
            grams = Grams(batch.column(1), least, most, len(gain))
            total = np.zeros(batch.num_rows, np.int64)
            for doc, slot, bucket, _ in grams.slots():
                np.add.at(total, doc, gain[bucket][slot])
            n = grams.features()
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams.words), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return _batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(task, schema)


def drawn(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``rows`` (a staged table with n_words, score, doc_id) with ``rank``, null for those that are not drawn.

    Scores are whole numbers of a narrow range: the logarithms of counts and of 32 bits are small. Their histogram is therefore
    short whatever the number of rows, and gives the score at which the draw ends; only rows from there on are ranked.
    """
    fit = F.col("n_words") >= least_words
    sizes = rows.filter(fit).groupBy("score").agg(F.count("*").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    row = rows.filter(fit).agg(F.count("*").alias("n")).first()
    take = row.n * percent // 100
    last = sizes.select("score", above.alias("above")).filter(F.col("above") < take).agg(F.min("score")).first()[0] if take else None
    if last is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    near = fit & (F.col("score") >= last)
    order = base.stage(rows.filter(near).withColumn("down", -F.col("score")).withColumn("unnamed", F.col("doc_id").isNull()), "near")
    order = base.ranked(order, [], ["down", "unnamed", "doc_id"], "draws").drop("n_ranked", "down", "unnamed")
    order = order.withColumn("rank", F.when(F.col("rank") < take, F.col("rank") + 1))
    return rows.filter(~near).withColumn("rank", F.lit(None).cast("long")).unionByName(order)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS,
             least: int = LEAST, most: int = MOST) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``; ``target`` needs a column ``text``.

    Null and empty texts have no words, weight 0 and no rank; texts of any length are read whole. Ties go to the
    smaller doc_id; a null id has the noise of an empty name and comes after all others. Repeated rows count, weigh and are drawn as
    separate rows. Empty tables give no counts, and no rows where ``docs`` is empty. Other columns take no part.
    """
    gain = gains(bucket_counts(docs, buckets, least, most), bucket_counts(target, buckets, least, most))
    rows = weighed(docs, gain, least, most).withColumn("score", F.col("weight") + noise(seed))
    return drawn(base.stage(rows, "weights"), percent, least_words)
