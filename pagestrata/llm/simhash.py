"""SimHash near-duplicates through an inverted index on byte positions, with count filtering.

Two fingerprints that differ in at most ``DISTANCE`` bits share at least 8 - ``DISTANCE`` of their 8 positional bytes. The
index lists every distinct fingerprint under each choice of that many positions with the bytes there: two fingerprints
that meet in a list have a tally of the guaranteed minimum at least, and all pairs with such a tally meet. (Lists of a
single position would hold a 256th of all fingerprints each, and their pairs would grow with the square.) A list fixes
all but ``DISTANCE`` bytes, so it has at most 256 ** ``DISTANCE`` fingerprints, whatever the input. Pairs of a list are
verified by their differing bits, and it passes on a spanning forest of its links, never all its pairs. Links of all
lists together give the components.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.llm import base
from pagestrata.llm.components import components

DISTANCE, SHINGLE, SEED = 2, 3, 42
_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint(text: str | None) -> int:
    """64 bits of a text, as a signed number; 0 without words."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z only, and white space of ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)
    parts = h.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(parts[:, j], minlength=256) @ _BITS for j in range(8)])
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(row_id, doc_id, fp) for every row."""
    base.small_batches(docs.sparkSession)
    return base.map_batches(
        base.with_row(docs, "doc_id", "text"),
        lambda b: {"row_id": b["row_id"], "doc_id": b["doc_id"], "fp": [fingerprint(t) for t in b["text"]]}, "row_id long, doc_id long, fp long",
    )


def _forest(prints: np.ndarray, free: list[int]) -> list[tuple[int, int]]:
    """Spanning links of the fingerprints of one list, which differ only in the bytes ``free``."""
    # the free bytes as one number; a neighbour is that number with few bits turned
    number = np.zeros(len(prints), np.int64)
    for i, j in enumerate(free):
        number |= ((prints >> np.uint64(8 * j)) & np.uint64(255)).astype(np.int64) << (8 * i)
    bits = 8 * len(free)
    slot = np.full(1 << bits, -1, np.int64) if len(prints) > 64 else None
    links, parent = [], list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    if slot is None:
        differ = np.bitwise_count(number[:, None] ^ number[None, :])
        pairs = np.argwhere(np.triu(differ <= DISTANCE, 1)).tolist()
    else:
        slot[number] = np.arange(len(prints))
        turns = [sum(1 << b for b in c) for n in range(1, DISTANCE + 1) for c in combinations(range(bits), n)]
        pairs = (
            (int(a), int(b)) for t in turns
            for there in [slot[number ^ t]] for a in np.flatnonzero(there > np.arange(len(prints))) for b in [there[a]]
        )
    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            parent[y] = x
            links.append((a, b))
    return links


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) at ``DISTANCE`` or fewer differing bits, enough to connect."""
    choices = list(combinations(range(8), 8 - DISTANCE))
    masks = [sum(255 << (8 * j) for j in c) for c in choices]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    entry = F.explode(F.array(*(F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes")) for k, m in enumerate(masks)))).alias("entry")
    index = prints.select("fp", entry).select("entry.choice", "entry.bytes", "fp")
    # a list of one is no list; the rest is split by list only, as a list is bounded
    ordered = index.repartition("choice", "bytes").sortWithinPartitions("choice", "bytes", "fp")

    def linked(batches):
        held = None
        for batch in batches:
            new = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            held = new if held is None else np.concatenate([held, new])
            edge = np.flatnonzero((held[1:, :2] != held[:-1, :2]).any(axis=1)) + 1
            if len(edge):
                yield from found(np.split(held[: edge[-1]], edge[:-1]) if len(edge) > 1 else [held[: edge[-1]]])
                held = held[edge[-1] :]
        if held is not None:
            yield from found([held])

    def found(lists):
        out = []
        for part in lists:
            if len(part) > 1:
                free = [j for j in range(8) if j not in choices[int(part[0, 0])]]
                out += [(int(part[a, 2]), int(part[b, 2])) for a, b in _forest(part[:, 2].astype(np.uint64), free)]
        if out:
            yield pa.RecordBatch.from_pydict({"a": [x for x, _ in out], "b": [y for _, y in out]})

    return ordered.mapInArrow(linked, "a long, b long")


def groups(docs: DataFrame) -> DataFrame:
    """(row_id, doc_id, fp, root): ``root`` names the component; rows of near-duplicate texts share it.

    Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows and exact copies meet in one
    fingerprint before any link is sought. Other columns are not looked at. No rows give no rows.
    """
    rows = base.stage(fingerprints(docs), "fingerprints")
    found = components(links(rows.select("fp").distinct()))
    return rows.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("row_id", "doc_id", "fp", F.coalesce("root", "fp").alias("root"))


def component_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): the component is named by its smallest doc_id; null if none has one."""
    rows = base.stage(groups(docs), "groups")
    named = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(named, "root").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row of each component with the smallest doc_id (then the first row), columns of ``docs`` as they are.

    Rows without id stay only if their component has none with one.
    """
    rows = base.stage(groups(docs), "groups")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")).alias("first")).select("first.row_id")
    numbered = docs.select(F.monotonically_increasing_id().alias("row_id"), F.struct(*docs.columns).alias("row"))
    return numbered.join(first, "row_id").select("row.*")
