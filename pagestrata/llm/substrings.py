"""Removal of word sequences that repeat anywhere, by FM-indexes over shards.

A window of ``WINDOW`` words can only repeat where its rarest-ranked ``GRAM``-gram (its minimizer, which follows from its
words alone) is found again. Neighbouring windows with the same minimizer form a segment, and a segment goes to
the shard of its minimizer, so equal windows always meet in one shard.

1. Grams that are very common in the corpus are counted; they rank last, so that a window is named by a rare gram as
   long as it has one, and no shard gathers a common phrase in all its surroundings.
2. Minimizers are counted over blocks of ``BLOCK`` documents, at most one row per block. Only segments whose minimizer
   is found twice go on, which is a small part of a corpus.
3. The distinct segments of a shard form its FM-index. Segments found once are streamed through it by backward
   search over the wavelet matrix; all windows that occur twice are reported as intervals. A segment found twice
   repeats as a whole.
4. Intervals go back to their documents, whose covered words are removed.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagestrata.llm import base
from pagestrata.llm.fmindex import FMIndex

WINDOW, GRAM = 35, 8
BLOCK, SHARD_WORDS = 512, 400_000
#: A gram is common if it makes up more than this part of all words; so at most as many grams are.
COMMON_PART = 50_000
_POWERS = np.array([pow(0x9E3779B97F4A7C15, j, 1 << 64) for j in range(64)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # of bytes: at x20 and x09-x0D only


def grams(docs: list[list[bytes]], gram: int) -> np.ndarray:
    """Numbers of the word sequences of length ``gram`` at every word of all documents in a row."""
    import xxhash

    h = np.array(list(map(xxhash.xxh64_intdigest, chain.from_iterable(docs))), np.uint64)
    n = max(len(h) - gram + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(gram):
        out += h[j : j + n] * _POWERS[j]
    return _mixed(out)


class Common:
    """Sorted numbers of common grams, with a coarse table before the search."""

    def __init__(self, numbers: np.ndarray):
        self.numbers = np.sort(numbers)
        self.coarse = np.zeros(1 << 20, bool)
        self.coarse[(self.numbers >> np.uint64(44)).astype(np.int64)] = True

    def holds(self, g: np.ndarray) -> np.ndarray:
        out = self.coarse[(g >> np.uint64(44)).astype(np.int64)]
        at = np.flatnonzero(out)
        place = np.minimum(np.searchsorted(self.numbers, g[at]), max(len(self.numbers) - 1, 0))
        out[at] = self.numbers[place] == g[at] if len(self.numbers) else False
        return out


def segments(docs: list[list[bytes]], common: Common, window: int = WINDOW, gram: int = GRAM):
    """(document, first window, last window, minimizer, whether it is common) of all segments, as arrays."""
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    ends = np.cumsum(sizes)
    g = grams(docs, gram)
    count = max(int(sizes.sum()) - window + 1, 0)
    if not count:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, bool))
    value = (g >> np.uint64(1)) | (common.holds(g).astype(np.uint64) << np.uint64(63))
    place = np.arange(len(value))
    reach, span = 1, window - gram + 1
    while reach < span:
        step = min(reach, span - reach)
        right = value[step:] < value[: len(value) - step]  # the left one of equals stays
        value, place = np.where(right, value[step:], value[: len(value) - step]), np.where(right, place[step:], place[: len(place) - step])
        reach += step
    start = np.arange(count)
    doc = np.searchsorted(ends, start, "right")
    valid = start + window <= ends[np.minimum(doc, len(ends) - 1)]
    start, doc, place = start[valid], doc[valid], place[:count][valid]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])) if len(start) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(start)) - 1
    base_of = ends[doc[new]] - sizes[doc[new]]
    key = g[place[new]]
    return doc[new], start[new] - base_of, start[last[: len(new)]] - base_of, key, common.holds(key)


def common_grams(docs: DataFrame, gram: int = GRAM) -> np.ndarray:
    """Grams above their part of all words: at most ``COMMON_PART`` numbers, counted over all documents.

    A task passes on what is frequent in its own batches; that misses nothing which is evenly common, and what it misses
    costs balance, not results.
    """
    def task(batches):
        for batch in batches:
            texts = [split(t) for t in batch.column(0).to_pylist()]
            total = sum(map(len, texts))
            found, n = np.unique(grams(texts, gram), return_counts=True)
            often = n >= max(4, total // (2 * COMMON_PART))
            yield pa.RecordBatch.from_pydict({"gram": np.append(found[often].view(np.int64), 0), "n": np.append(n[often], 0), "words": np.append(np.zeros(int(often.sum()), np.int64), total)})

    rows = base.stage(docs.select("text").mapInArrow(task, "gram long, n long, words long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("words").alias("words")), "grams")
    total = rows.agg(F.sum("words")).first()[0] or 0
    least = max(total // COMMON_PART, 16)
    return rows.filter(F.col("n") > least).select("gram").toPandas()["gram"].to_numpy(np.int64).view(np.uint64)


def _keys_per_block(docs: DataFrame, sent) -> DataFrame:
    """(block, key): minimizers of a block that occur again in it or in another block, without the common ones."""
    def task(batch, common):
        doc, _, _, key, hot = segments([split(t) for t in batch["text"]], common, sent.value[1], sent.value[2])
        block = np.array(batch["row_id"], np.int64)[doc] // BLOCK
        order = np.lexsort((key, block))[~hot[np.lexsort((key, block))]]
        key, block = key[order], block[order]
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])])) if len(key) else np.zeros(0, np.int64)
        return {"block": block[first], "key": key[first].view(np.int64), "n": np.diff(np.append(first, len(key)))}

    rows = base.map_batches(docs, task, "block long, key long, n long", start=lambda: Common(sent.value[0]))
    return rows.withColumn("n", F.sum("n").over(Window.partitionBy("key"))).filter(F.col("n") > 1).select("block", "key").distinct()


def _flagged(docs: DataFrame, sent) -> DataFrame:
    """Every row with n_words and the hash of its words; text and segments where a minimizer occurs again."""
    keys = _keys_per_block(docs, sent)
    schema = "row_id long, doc_id long, n_words long, whole string, text string, segments array<struct<first:int,last:int,key:long>>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        common = Common(sent.value[0])
        again = np.sort(right.column("key").to_numpy()) if right.num_rows else np.zeros(0, np.int64)
        rows, ids, texts = left.column("row_id").to_pylist(), left.column("doc_id").to_pylist(), left.column("text").to_pylist()
        words = [split(t) for t in texts]
        doc, first, last, key, hot = segments(words, common, sent.value[1], sent.value[2])
        key = key.view(np.int64)
        kept = hot.copy()
        if len(again):
            kept |= again[np.minimum(np.searchsorted(again, key), len(again) - 1)] == key
        listed: list[list] = [[] for _ in rows]
        for d, a, b, k in zip(*(x[kept].tolist() for x in (doc, first, last, key))):
            listed[d].append({"first": a, "last": b, "key": k})
        return pa.Table.from_pydict({
            "row_id": rows, "doc_id": ids, "n_words": list(map(len, words)), "whole": [hashlib.sha256(b" ".join(w)).hexdigest() for w in words],
            "text": [t if s else None for t, s in zip(texts, listed)], "segments": listed,
        }, schema=arrow)

    blocks = docs.withColumn("block", F.floor(F.col("row_id") / BLOCK))
    return blocks.groupBy("block").cogroup(keys.groupBy("block")).applyInArrow(task, schema)


def _contents(flagged: DataFrame, window: int, with_text: bool) -> DataFrame:
    """Segments by the digest of their words: the words once per batch and how often, or the places of all."""
    schema = "digest binary, key long, words string, n long" if with_text else "digest binary, row_id long, first int"

    def task(batch):
        held: dict[bytes, list] = {}
        places = []
        for row, text, listed in zip(batch["row_id"], batch["text"], batch["segments"]):
            words = split(text)
            for s in listed:
                content = b" ".join(words[s["first"] : s["last"] + window])
                digest = hashlib.sha256(content).digest()[:20]
                if with_text:
                    held.setdefault(digest, [s["key"], content.decode(), 0])[2] += 1
                else:
                    places.append((digest, row, s["first"]))
        if with_text:
            return {"digest": list(held), "key": [v[0] for v in held.values()], "words": [v[1] for v in held.values()], "n": [v[2] for v in held.values()]}
        return {"digest": [p[0] for p in places], "row_id": [p[1] for p in places], "first": [p[2] for p in places]}

    return base.map_batches(flagged, task, schema)


def search_shard(contents: list[list[bytes]], counts: np.ndarray, window: int) -> list[list[tuple[int, int]]]:
    """Intervals (from, to) of repeated windows in each distinct segment of one shard."""
    number: dict[bytes, int] = {}
    flat = list(chain.from_iterable([*c, None] for c in contents))
    symbols = np.array([1 if w is None else number.setdefault(w, len(number) + 2) for w in flat], np.int64)
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    windows = sizes - window + 1
    index = FMIndex(symbols)
    single = np.flatnonzero(counts < 2)
    n = windows[single]
    starts = np.repeat(begin[single], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    again = index.occurs_again(symbols, starts, window)
    out = [[(0, int(w))] if c > 1 else [] for w, c in zip(windows, counts)]
    for s, part in zip(single.tolist(), np.split(again, np.cumsum(n)[:-1]) if len(single) else []):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], part.astype(np.int8), [0]])))
        out[s] = [(a, b) for a, b in edge.reshape(-1, 2).tolist()]
    return out


def repeated(flagged: DataFrame, window: int) -> DataFrame:
    """(row_id, hits): word intervals [from, to) of every flagged row that repeat."""
    chosen = flagged.filter(F.size("segments") > 0).select("row_id", "text", "segments")
    words = chosen.select(F.sum(F.aggregate("segments", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"] + window))).first()[0] or 0
    shards = int(words // SHARD_WORDS) + 1
    schema = "digest binary, hits array<struct<start:int,stop:int>>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def search(part: pa.Table) -> pa.Table:
        held: dict[bytes, list] = {}
        for digest, text, n in zip(*(part.column(c).to_pylist() for c in ("digest", "words", "n"))):
            held.setdefault(digest, [text, 0])[1] += n
        hits = search_shard([v[0].encode().split(b" ") for v in held.values()], np.array([v[1] for v in held.values()]), window)
        some = [(d, h) for d, h in zip(held, hits) if h]
        return pa.Table.from_pydict({"digest": [d for d, _ in some], "hits": [[{"start": a, "stop": b + window - 1} for a, b in h] for _, h in some]}, schema=arrow)

    found = (
        _contents(chosen, window, True).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
        .groupBy("shard").applyInArrow(search, schema)
    )
    placed = _contents(chosen, window, False).join(found, "digest")
    moved = F.transform("hits", lambda h: F.struct((h["start"] + F.col("first")).alias("start"), (h["stop"] + F.col("first")).alias("stop")))
    return placed.select("row_id", moved.alias("hits")).groupBy("row_id").agg(F.flatten(F.collect_list("hits")).alias("hits"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """(row_id, doc_id, n_words, n_removed, kept_sha256[, text]): documents without the words of repeated windows.

    A window repeats if its words also start anywhere else, in the same document or another, equal rows included. Words
    are parted by x20 and x09-x0D; ``text`` has the kept words with one space between. Null and empty texts have no
    words; texts shorter than a window keep all. Other columns are not looked at. No rows give no rows.
    """
    if not 1 <= gram <= window:
        raise ValueError("a gram is no longer than a window")
    base.small_batches(docs.sparkSession, BLOCK)
    rows = base.with_row(docs, "doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast((common_grams(docs, gram), window, gram))
    flagged = base.stage(_flagged(rows, sent), "segments")
    hits = repeated(flagged, window)
    schema = "row_id long, n_removed long, kept_sha256 string" + (", text string" if with_text else "")

    def cut(batch):
        out = {"row_id": batch["row_id"], "n_removed": [], "kept_sha256": []} | ({"text": []} if with_text else {})
        for text, spans in zip(batch["text"], batch["hits"]):
            words = split(text)
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, [s["start"] for s in spans], 1)
            np.add.at(cover, [s["stop"] for s in spans], -1)
            gone = np.cumsum(cover)[:-1] > 0
            kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
            out["n_removed"].append(int(gone.sum()))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if with_text:
                out["text"].append(kept.decode())
        return out

    changed = base.map_batches(flagged.select("row_id", "text").join(hits, "row_id"), cut, schema)
    whole = flagged.select("row_id", "doc_id", "n_words", "whole")
    columns = ["row_id", "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "whole").alias("kept_sha256")]
    if with_text:
        plain = docs.select(F.monotonically_increasing_id().alias("row_id"), F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+", " ").alias("plain"))
        return whole.join(changed, "row_id", "left").join(plain, "row_id").select(*columns, F.coalesce("text", "plain").alias("text"))
    return whole.join(changed, "row_id", "left").select(*columns)
