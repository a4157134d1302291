"""Benchmark passages in training documents, through suffix arrays over the training text.

Every batch of documents is a shard. Its words become numbers of the benchmark's vocabulary (0 for any other word), its
suffixes that can match at all (they start with enough benchmark words) are sorted to a suffix array, and every
suffix of every benchmark text is searched in it. A hit's neighbours are read on until the texts differ, which gives the
longest verbatim match and its place. Nothing is shuffled, and a document never leaves its task.

The benchmark is cut into blocks of ``BLOCK_BYTES`` of text; each block is sent to the tasks once and passes over the
documents in its own step of the same scan, so a large benchmark costs more steps and no more memory per block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagestrata.llm import base

WINDOW = 10
BLOCK_BYTES = 32 << 20
#: Words are runs of a-z, 0-9 and everything outside ASCII; all else parts words.
_TABLE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of a text."""
    return (text or "").encode().lower().translate(_TABLE).split()


class Benchmark:
    """Windows of one block's items, packed so that byte order is suffix order."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int):
        self.window, self.vocabulary = window, {}
        texts = [(item, words(text)) for item, text in items]
        for _, ws in texts:
            for w in ws:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        low, high, self.item, self.at, self.length, self.rest = [], [], [], [], [], []
        for item, ws in texts:
            ids = np.array([self.vocabulary[w] for w in ws], ">u4")
            for i in range(max(len(ids) - window + 1, min(len(ids), 1))):
                w = ids[i : i + window]
                low.append(w.tobytes() + b"\0" * (4 * (window - len(w))))
                high.append(w.tobytes() + b"\xff" * (4 * (window - len(w))))
                self.item.append(item)
                self.at.append(i)
                self.length.append(len(w))
                self.rest.append(ids[i:])
        self.low, self.high = (np.array(x, f"S{4 * window}") for x in (low, high))
        self.sizes = np.array(self.length, np.int64)
        self.shortest = min(self.length, default=window)

    def search(self, docs: list[list[bytes]]):
        """(document, place, window number) of every occurrence, and the number of words of each document."""
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        ids = np.zeros(int(sizes.sum()) + len(docs) + self.window, np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(docs) else np.zeros(0, np.int64)
        get, zero = self.vocabulary.get, 0
        for s, ws in zip(starts.tolist(), docs):
            ids[s : s + len(ws)] = [get(w, zero) for w in ws]
        # words known from here on, up to the next other word
        other = np.flatnonzero(ids == 0)
        known = np.flatnonzero(ids)
        run = other[np.searchsorted(other, known)] - known
        suffixes = known[run >= self.shortest]
        if not len(suffixes) or not len(self.low):
            return np.zeros((0, 3), np.int64), ids, starts
        grid = ids[suffixes[:, None] + np.arange(self.window)[None, :]]
        grid[np.cumsum(grid == 0, axis=1) > 0] = 0
        keys = np.ascontiguousarray(grid.astype(">u4")).view(f"S{4 * self.window}").ravel()
        order = np.argsort(keys, kind="stable")
        array, keys = suffixes[order], keys[order]
        first, last = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        n = last - first
        window = np.repeat(np.arange(len(n)), n)
        place = array[np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))]
        doc = np.searchsorted(starts, place, "right") - 1
        return np.column_stack([doc, place - starts[doc], window]).astype(np.int64), ids, starts


def _blocks(benchmark: DataFrame):
    """Rows of the benchmark in blocks of bounded size; a single item is never cut."""
    slim = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = int(size // BLOCK_BYTES) + 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for k in range(count):
        yield [(r.item_id, r.text) for r in slim.filter(part == k).collect()] if count > 1 else [(r.item_id, r.text) for r in slim.collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, the columns of ``keep``, n_words, hits (covered word numbers as runs), items.

    A document word is hit if it lies in an occurrence of a window: ``window`` consecutive words of an item, or all of
    an item that has fewer. Null and empty texts, and texts without a word, have no words and no hits; an item without
    words has no window. An item that is repeated counts once; an item without id hits words but is not listed. Empty
    tables give no rows or no hits.
    """
    base.small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    names = ["doc_id", *dict.fromkeys(c for c in keep if c not in ("doc_id", "text"))]
    df = docs.select(
        F.struct(*names).alias("kept"), F.col("text"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<array<long>>").alias("hits"), F.array().cast("array<long>").alias("items"),
    )
    for items in _blocks(benchmark):
        sent = sc.broadcast((items, window))
        arrow = to_arrow_schema(df.schema)

        def task(batches, sent=sent, arrow=arrow):
            block = Benchmark(*sent.value)
            for batch in batches:
                texts = [words(t) for t in batch.column("text").to_pylist()]
                found, _, _ = block.search(texts)
                hits, listed = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
                found = found[np.argsort(found[:, 0], kind="stable")]
                cut = np.flatnonzero(np.diff(found[:, 0])) + 1
                for group in np.split(found, cut) if len(found) else []:
                    d = int(group[0, 0])
                    cover = np.zeros(len(texts[d]) + 1, np.int64)
                    np.add.at(cover, group[:, 1], 1)
                    np.add.at(cover, group[:, 1] + block.sizes[group[:, 2]], -1)
                    for a, b in hits[d]:
                        cover[a] += 1
                        cover[b] -= 1
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(cover) > 0).astype(np.int8)])))
                    hits[d] = edge.reshape(-1, 2).tolist()
                    new = {block.item[k] for k in group[:, 2].tolist()} - {None}
                    listed[d] = sorted(new | set(listed[d]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("kept"), batch.column("text"), pa.array(list(map(len, texts)), pa.int64()),
                     pa.array(hits, arrow.field("hits").type), pa.array(listed, arrow.field("items").type)],
                    schema=pa.schema([pa.field("kept", batch.schema.field("kept").type), pa.field("text", batch.schema.field("text").type), arrow.field("n_words"), arrow.field("hits"), arrow.field("items")]),
                )

        df = df.mapInArrow(task, df.schema)
    return df.select("kept.*", "text", "n_words", "hits", "items")


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, item_word, doc_id, doc_word, n_words): every maximal verbatim match of at least a window.

    A match is as long as the texts agree from there on, and starts where it cannot start a word earlier. Cases as in
    ``contamination``.
    """
    base.small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    schema = "item_id long, item_word long, doc_id long, doc_word long, n_words long"
    out = None
    for items in _blocks(benchmark):
        sent = sc.broadcast((items, window))

        def task(batch, block):
            found, ids, starts = block.search([words(t) for t in batch["text"]])
            rows = {k: [] for k in ("item_id", "item_word", "doc_id", "doc_word", "n_words")}
            seen = {(d, p, block.item[w], block.at[w]) for d, p, w in found.tolist()}
            for d, p, w in found.tolist():
                if (d, p - 1, block.item[w], block.at[w] - 1) in seen:
                    continue
                ours, text = block.rest[w], ids[starts[d] + p :]
                n = min(len(ours), len(text))
                differs = np.flatnonzero(ours[:n] != text[:n])
                for k, v in zip(rows, (block.item[w], block.at[w], batch["doc_id"][d], p, int(differs[0]) if len(differs) else n)):
                    rows[k].append(v)
            return rows

        part = base.map_batches(docs.select("doc_id", "text"), task, schema, start=lambda sent=sent: Benchmark(*sent.value))
        out = part if out is None else out.unionByName(part)
    return out


def digest(found: DataFrame) -> DataFrame:
    """Columns of the contract from ``contamination``."""
    covered = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    listed = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"), (covered > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark, columns as they are."""
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns)}  # no column of the documents clashes with a result
    frame = docs.select("doc_id", "text", *(F.col(c).alias(n) for c, n in own.items() if c != "text"))
    found = contamination(frame, benchmark, window, keep=tuple(n for c, n in own.items() if c != "text")).filter(F.size("hits") == 0)
    return found.select(*(F.col("text" if c == "text" else n).alias(c) for c, n in own.items()))
