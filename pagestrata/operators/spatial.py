"""Box-overlap joins, components and greedy selection as distributed jobs.

Pairs are found by joining on (key, grid cell), so a page that owns a large share
of all boxes is spread over its cells. Cells are as fine as their boxes are many: a cell with
more than ``DENSE`` boxes is cut like a quadtree, level by level, while its boxes do not
multiply beyond ``SPREAD``. Every touching pair meets in exactly one
counted cell, the one that holds the top-left corner of the common part, so no
``distinct`` follows the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagestrata.functions.geometry import Box, box
from pagestrata.operators.folds import fold, split_by_size
from pagestrata.session import cut_lineage, saved

#: A cell holds an ordinary page, whose boxes then take part in a join once each.
CELL_PX = 2048
#: Boxes of a cell above which it is cut, cuts at most, and rows a box may become in them on average.
DENSE, LEVELS, SPREAD = 256, 8, 96
#: Cells that are cut at most; so many rows are sent to every task.
CUT_CELLS = 100_000
#: Links of a key up to which one task settles it from memory.
KEY_LINKS = 50_000


def _span(low: Column, high: Column, px: int | Column) -> Column:
    return F.sequence(F.floor(low / px), F.floor(high / px))


def _on_grid(df: DataFrame, b: Box, pad: int) -> DataFrame:
    """Each box, grown by ``pad``, once per cell; ``__x1 .. __y2`` is the part of it in the cell."""
    low_x, low_y = b.x1 - pad, b.y1 - pad
    high_x, high_y = F.greatest(b.x1, b.x2) + pad, F.greatest(b.y1, b.y2) + pad
    placed = df.withColumn("__cx", F.explode(_span(low_x, high_x, CELL_PX))).withColumn("__cy", F.explode(_span(low_y, high_y, CELL_PX)))
    left, top = F.col("__cx") * CELL_PX, F.col("__cy") * CELL_PX
    return placed.withColumns({
        "__x1": F.greatest(low_x, left), "__x2": F.least(high_x, left + CELL_PX - 1), "__y1": F.greatest(low_y, top), "__y2": F.least(high_y, top + CELL_PX - 1)})


def _dense_cells(boxes: DataFrame, keys: Sequence[str], times: int = 1) -> DataFrame:
    """Cells to be cut and the edge length of their parts: ``keys, __cx, __cy, __px``; the densest ``CUT_CELLS`` at most.

    ``times`` is 2 where ``boxes`` stand for both sides of a join.
    """
    def parts(px: int) -> Column:
        bits = px.bit_length() - 1  # whole pixels
        wide = F.shiftright("__x2", bits) - F.shiftright("__x1", bits) + 1
        return wide * (F.shiftright("__y2", bits) - F.shiftright("__y1", bits) + 1)

    edges = [CELL_PX >> k for k in range(1, LEVELS + 1)]
    whole = boxes.select(*keys, "__cx", "__cy", *(F.col(c).cast("long").alias(c) for c in ("__x1", "__y1", "__x2", "__y2")))
    counted = whole.groupBy(*keys, "__cx", "__cy").agg((F.count("*") * times).alias("__n"), *((F.sum(parts(px)) * times).alias(f"__r{px}") for px in edges)).where(F.col("__n") > DENSE)
    fine = [F.when((F.col("__n") > DENSE * 4**k) & (F.col(f"__r{px}") <= SPREAD * F.col("__n")), F.lit(px)) for k, px in enumerate(edges)]
    dense = counted.select(*keys, "__cx", "__cy", F.least(*fine).alias("__px"), "__n").where(F.col("__px").isNotNull())
    return dense.orderBy(F.desc("__n")).limit(CUT_CELLS).drop("__n")


def _in_parts(placed: DataFrame, dense: DataFrame, keys: Sequence[str]) -> DataFrame:
    px = F.coalesce("__px", F.lit(CELL_PX))
    cut = placed.join(F.broadcast(dense), [*keys, "__cx", "__cy"], "left").withColumn("__px", px)
    return cut.withColumn("__sx", F.explode(_span(F.col("__x1"), F.col("__x2"), F.col("__px")))).withColumn(
        "__sy", F.explode(_span(F.col("__y1"), F.col("__y2"), F.col("__px")))).drop("__cx", "__cy", "__x1", "__y1", "__x2", "__y2")


def _prefixed(df: DataFrame, prefix: str, keys: Sequence[str]) -> DataFrame:
    return df.select(*(F.col(c).alias(c if c in keys else f"{prefix}{c}") for c in df.columns))


def touching_pairs(
    left: DataFrame, right: DataFrame, keys: Sequence[str], pad: int = 0,
    left_prefix: str = "l_", right_prefix: str = "r_",
) -> DataFrame:
    """All pairs of the same key whose boxes, the right one grown by ``pad``, touch.

    Both sides bring ``x1, y1, x2, y2`` in whole pixels; other columns come out prefixed.
    """
    keys = list(keys)
    a, b = box(left_prefix), box(right_prefix)
    l = _on_grid(_prefixed(left, left_prefix, keys), a, 0)
    r = _on_grid(_prefixed(right, right_prefix, keys), b, pad)
    slim = [*keys, "__cx", "__cy", "__x1", "__y1", "__x2", "__y2"]
    same = left is right and not pad
    dense = _dense_cells(l.select(slim) if same else l.select(slim).unionByName(r.select(slim)), keys, 2 if same else 1)
    corner_x, corner_y = F.greatest(a.x1, b.x1 - pad), F.greatest(a.y1, b.y1 - pad)
    touch = (
        (corner_x <= F.least(a.x2, b.x2 + pad)) & (corner_y <= F.least(a.y2, b.y2 + pad))
    )
    counted = (F.floor(corner_x / F.col("__px")) == F.col("__sx")) & (F.floor(corner_y / F.col("__px")) == F.col("__sy"))
    met = _in_parts(l, dense, keys).join(_in_parts(r, dense, keys), [*keys, "__px", "__sx", "__sy"])
    return met.where(touch & counted).drop("__px", "__sx", "__sy")


class _Links:
    """The links of one key, ``__s`` to ``__d``; ``names`` are the key's columns."""

    def __init__(self, names: Sequence[str]):
        self.names, self.key, self.links = names, None, []

    def add(self, row: dict) -> None:
        self.key = self.key or {n: row[n] for n in self.names}
        self.links.append((row["__s"], row["__d"]))


class _Components(_Links):
    """Smallest node of each component, by union-find."""

    def result(self) -> list[dict]:
        up: dict = {}

        def root(node):
            while up[node] != node:
                up[node] = node = up[up[node]]
            return node

        for a, b in self.links:
            up.setdefault(a, a)
            up.setdefault(b, b)
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
        return [{**self.key, "__node": node, "__label": root(node)} for node in up]


class _Dropped(_Links):
    """Nodes with a kept stronger neighbour: a node is settled once all its stronger neighbours are."""

    def result(self) -> list[dict]:
        weaker, waits = {}, {}
        for strong, weak in self.links:
            weaker.setdefault(strong, []).append(weak)
            waits[weak] = waits.get(weak, 0) + 1
        lost, todo = set(), [node for node in weaker if node not in waits]
        while todo:
            node = todo.pop()
            for weak in weaker.get(node, ()):
                if node not in lost:
                    lost.add(weak)
                waits[weak] -= 1
                if not waits[weak]:
                    todo.append(weak)
        return [{**self.key, "__n": node} for node in lost]


def _settled(links: DataFrame, keys: list[str], make: type[_Links], out: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """Result of the keys whose links one task can hold, and the links of the other keys if there are any."""
    kept = {f.name: f for f in links.schema.fields}
    schema = T.StructType([*(kept[k] for k in keys), *(T.StructField(n, kept["__s"].dataType) for n in out)])
    small, big = split_by_size(links, keys, KEY_LINKS)
    return fold(small, keys, [], lambda: make(keys), schema), big


def connected_components(
    nodes: DataFrame, edges: DataFrame, keys: Sequence[str], node: str, src: str, dst: str,
    name: str = "component",
) -> DataFrame:
    """Smallest node of each node's component: keys of ordinary size in one pass, the others in rounds."""
    keys = list(keys)
    links = saved(edges.select(*keys, F.col(src).alias("__s"), F.col(dst).alias("__d")), "links")
    labels, big = _settled(links, keys, _Components, ("__node", "__label"))
    if big is not None:
        labels = labels.unionByName(_labels_by_rounds(big, keys))
    named = labels.select(*keys, F.col("__node").alias(node), F.col("__label").alias("__component"))
    return nodes.join(named, [*keys, node], "left").withColumn(
        name, F.coalesce("__component", node)
    ).drop("__component")


def _labels_by_rounds(links: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest node of the component of each linked node, by minimum labels with pointer jumping.

    Hubs are safe: neighbours' labels are reduced by a partial ``min``. Each round is
    checkpointed; only the count of changed rows reaches the driver.
    """
    both = links.select(*keys, F.col("__s").alias("__u"), F.col("__d").alias("__v")).unionByName(
        links.select(*keys, F.col("__d").alias("__u"), F.col("__s").alias("__v"))
    )
    both = cut_lineage(both.distinct())
    # only nodes with an edge take part in the rounds
    labels = cut_lineage(
        both.select(*keys, F.col("__u").alias("__node")).distinct().withColumn("__label", F.col("__node"))
    )
    while True:
        heard = (
            both.join(labels.withColumnRenamed("__node", "__v"), [*keys, "__v"])
            .groupBy(*keys, F.col("__u").alias("__node"))
            .agg(F.min("__label").alias("__heard"))
        )
        lowered = labels.join(heard, [*keys, "__node"]).select(
            *keys, "__node", F.least("__label", "__heard").alias("__label"), F.col("__label").alias("__old")
        )
        lowered = cut_lineage(lowered)
        roots = lowered.select(*keys, F.col("__node").alias("__label"), F.col("__label").alias("__root"))
        jumped = cut_lineage(
            lowered.join(roots, [*keys, "__label"]).select(
                *keys, "__node", F.least("__label", "__root").alias("__label"), "__old"
            )
        )
        changed = jumped.where(F.col("__label") != F.col("__old")).limit(1).count()
        labels = jumped.select(*keys, "__node", "__label")
        if not changed:
            return labels


def greedy_keep(
    nodes: DataFrame, edges: DataFrame, keys: Sequence[str], node: str, strong: str, weak: str
) -> DataFrame:
    """Nodes a best-first pass would keep: those with no kept stronger neighbour.

    Exact for any graph whose edges point from the stronger to the weaker node. Keys of
    ordinary size are settled in one pass, the others in rounds.
    """
    keys = list(keys)
    links = saved(edges.select(*keys, F.col(strong).alias("__s"), F.col(weak).alias("__d")), "links")
    lost, big = _settled(links, keys, _Dropped, ("__n",))
    dropped = None if big is None else _dropped_by_rounds(big, keys)
    lost = lost if dropped is None else lost.unionByName(dropped)
    return nodes.join(lost.withColumnRenamed("__n", node), [*keys, node], "left_anti")


def _dropped_by_rounds(links: DataFrame, keys: list[str]) -> DataFrame | None:
    """A round keeps every open node without an open stronger neighbour and drops its neighbours,
    so rounds are as many as the longest chain of decisions, not the number of nodes.
    """
    open_edges = cut_lineage(links.withColumnRenamed("__d", "__w"))
    dropped = None
    while not open_edges.isEmpty():
        waiting = open_edges.select(*keys, F.col("__w").alias("__n")).distinct()
        leaders = open_edges.select(*keys, F.col("__s").alias("__n")).distinct().join(
            waiting, [*keys, "__n"], "left_anti"
        )
        lost = cut_lineage(
            open_edges.join(leaders.withColumnRenamed("__n", "__s"), [*keys, "__s"], "left_semi")
            .select(*keys, F.col("__w").alias("__n"))
            .distinct()
        )
        dropped = lost if dropped is None else dropped.unionByName(lost)
        without_lost = open_edges.join(
            lost.withColumnRenamed("__n", "__w"), [*keys, "__w"], "left_anti"
        ).join(lost.withColumnRenamed("__n", "__s"), [*keys, "__s"], "left_anti")
        open_edges = cut_lineage(without_lost)
    return dropped
