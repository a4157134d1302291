"""Best-fit packing by linear grouping.

Lengths are whole numbers up to the capacity, so the table of how many pieces have each length has at most ``capacity``
rows, however many documents there are. The plan is made on that table alone, in intervals of ranks:

1. Large lengths, longest first, fall into groups of equal cardinality; each is rounded up to the longest of its group.
2. Configurations of the few rounded sizes are chosen one by one: the largest size left, filled up by the best
   sum of the others (bounded knapsack), and used as often as its groups allow.
3. Actual lengths take the places of the rounded ones, which leaves more room; runs of equal room stay intervals.
4. Small lengths, longest first, go to the fullest sequences that still hold them; new ones open when none does.

Each piece then finds its place from its length and its rank among pieces of that length, by a search in the plan. Ranks
come from counts per (length, bucket), so no length is numbered in one task.
"""

from __future__ import annotations

import os
import zlib
from collections import deque

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.llm import base

CAPACITY, GROUPS, SMALL = 1024, 256, 256
ROWS_PER_BUCKET, MOST_BUCKETS = 256, 65_536


def byte_ranks(tokenizer) -> dict[bytes, int]:
    """Bytes and id of every ordinary token of a byte-level vocabulary.

    Such a vocabulary writes printable Latin-1 bytes as themselves and the others, in order, as the characters from 256 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    value = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    return {bytes(value[c] for c in piece): i for piece, i in tokenizer.get_vocab().items() if piece not in special}


class Encoder:
    """Ids of whole texts as a byte-level tokenizer gives them.

    Its merges are ranked by id, so the same vocabulary as ranks, split by the same pattern, gives the same ids at a part of
    the cost. Texts with a special string, and texts that the pattern gives up on (millions of spaces in a row), are left to
    the tokenizer itself.
    """

    def __init__(self, tokenizer_path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=byte_ranks(self.tokenizer), special_tokens={})

    def ids(self, text: str) -> bytes:
        if not any(s in text for s in self.special):
            try:
                return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except ValueError:  # the pattern ran out of its stack
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        return [self.ids(t) for t in texts]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(tokenizer_path: str, pattern: str) -> Encoder:
    """The worker's encoder, kept from task to task."""
    key = (tokenizer_path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def pieces(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int = 2, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """(row_id, doc_id, piece, start, length, ids_crc32[, ids]): documents as ids, cut only if longer than ``capacity``.

    The first piece of a cut document is the short one.
    """
    base.small_batches(docs.sparkSession)
    schema = "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    end = np.array([end_id], "<u4").tobytes()

    def cut(batch, encoder):
        rows = {k.split()[0]: [] for k in schema.split(", ")}
        for row, doc, ids in zip(batch["row_id"], batch["doc_id"], encoder.encode([t or "" for t in batch["text"]])):
            ids += end
            total = len(ids) // 4
            a, b, k = 0, (total - 1) % capacity + 1, 0
            while a < total:
                part = ids[4 * a : 4 * b]
                for name, value in zip(rows, (row, doc, k, a, b - a, zlib.crc32(part), part)):
                    rows[name].append(value)
                a, b, k = b, b + capacity, k + 1
        return rows

    return base.map_batches(base.with_row(docs, "doc_id", "text"), cut, schema, start=lambda: encoder(tokenizer_path, pattern))


class Plan:
    """Places of (length, rank) pairs, from the number of pieces of each length."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL):
        self.capacity, self.used, self.rows = capacity, 0, []
        self.room: list[deque] = [deque() for _ in range(capacity + 1)]  # by room left: (first sequence, how many)
        large = sorted((s for s in counts if s > small and counts[s]), reverse=True)
        if large:
            self._large(np.array(large), np.array([counts[s] for s in large], np.int64), groups)
        for s in sorted((s for s in counts if s <= small and counts[s]), reverse=True):
            self._best_fit(s, counts[s])
        rows = np.array(sorted(self.rows), np.int64).reshape(-1, 5)
        self.length, self.first, self.count, self.sequence, self.offset = rows.T

    def _large(self, sizes, counts, groups):
        ends = np.cumsum(counts)
        total = int(ends[-1])
        each = -(-total // groups)
        left, taken, rounded = [], [], []
        for a in range(0, total, each):
            left.append(min(each, total - a))
            taken.append(a)
            rounded.append(int(sizes[np.searchsorted(ends, a, "right")]))
        for g in range(len(left)):
            while left[g]:
                config = self._configuration(g, rounded, left)
                times = min(left[k] // m for k, m in config.items())
                slots = []
                for k, m in config.items():
                    for _ in range(m):
                        slots.append(taken[k])
                        taken[k] += times
                        left[k] -= times
                self._substitute(slots, times, sizes, ends)

    def _configuration(self, g, rounded, left) -> dict[int, int]:
        """Largest size g and the sizes after it whose sum comes closest to the capacity."""
        best: list[dict | None] = [None] * (self.capacity - rounded[g] + 1)
        best[0] = {g: 1}
        for k in range(g, len(rounded)):
            spare = left[k] - (k == g)
            for at in range(len(best) - 1, -1, -1):
                if best[at] is None:
                    continue
                for m in range(1, spare + 1):
                    to = at + m * rounded[k]
                    if to >= len(best):
                        break
                    if best[to] is None:
                        best[to] = {**best[at], k: best[at].get(k, 0) + m}
            if best[-1] is not None:
                break
        return next(x for x in reversed(best) if x is not None)

    def _substitute(self, slots, times, sizes, ends):
        """Real lengths in ``times`` equal configurations; a slot holds the ranks from its start on."""
        starts = np.concatenate([[0], ends[:-1]])
        cuts = {0, times}
        for s in slots:
            inner = ends[(ends > s) & (ends < s + times)] - s
            cuts.update(inner.tolist())
        cuts = sorted(cuts)
        for a, b in zip(cuts, cuts[1:]):
            offset = 0
            for s in slots:
                k = int(np.searchsorted(ends, s + a, "right"))
                self.rows.append((int(sizes[k]), int(s + a - starts[k]), b - a, self.used + a, offset))
                offset += int(sizes[k])
            self.room[self.capacity - offset].append((self.used + a, b - a))
        self.used += times

    def _best_fit(self, size, count):
        first = 0
        while count:
            room = next((r for r in range(size, self.capacity + 1) if self.room[r]), None)
            if room is None:
                opened = -(-count // (self.capacity // size))
                self.room[self.capacity].append((self.used, opened))
                self.used += opened
                continue
            sequence, many = self.room[room].popleft()
            n = min(many, count)
            if many > n:
                self.room[room].appendleft((sequence + n, many - n))
            self.rows.append((size, first, n, sequence, self.capacity - room))
            self.room[room - size].append((sequence, n))
            first, count = first + n, count - n

    def places(self, length, rank):
        """(sequence, offset) of each pair."""
        key = (self.length << 44) + self.first
        at = np.searchsorted(key, (length << 44) + rank, "right") - 1
        return self.sequence[at] + rank - self.first[at], self.offset[at]


def ranked(items: DataFrame, total: int) -> DataFrame:
    """``items`` with ``rank``: 0, 1, ... within each length, numbered in buckets and shifted by the earlier ones."""
    buckets = min(max(total // ROWS_PER_BUCKET, 16), MOST_BUCKETS)
    put = items.withColumn("bucket", F.pmod(F.xxhash64("row_id", "piece"), F.lit(buckets)))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row_id", "piece"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = put.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    return put.withColumn("inside", inside).join(sizes, ["length", "bucket"]).withColumn("rank", F.col("inside") - 1 + F.col("before")).drop("bucket", "inside", "before")


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int = 2, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """One row per piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A null or empty text is one piece that holds only the end id. Repeated rows are packed each. Ties between equal
    lengths go by row. Other columns are not looked at. No rows give no rows.
    """
    items = base.stage(pieces(docs, tokenizer_path, pattern, end_id, capacity, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    plan = docs.sparkSession.sparkContext.broadcast(Plan(counts, capacity))
    slim = ranked(items.select("row_id", "doc_id", "piece", "start", "length", "ids_crc32"), sum(counts.values()))
    schema = "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def placed(batch, plan):
        sequence, offset = plan.places(np.array(batch["length"], np.int64), np.array(batch.pop("rank"), np.int64))
        return batch | {"sequence_id": sequence, "offset": offset}

    out = base.map_batches(slim, placed, schema, start=lambda: plan.value)
    if with_ids:
        out = out.join(items.select("row_id", "piece", "ids"), ["row_id", "piece"])
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))
