"""Pair joins on cells as fine as their boxes are many, and painted areas, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagestrata.functions.geometry import box
from pagestrata.operators import masks, spatial

COLS = "page_id long, n long, x1 long, y1 long, x2 long, y2 long"


def boxes(pick, n, side, page=(700, 600)):
    out = []
    for i in range(n):
        x, y = pick.randrange(-20, page[0]), pick.randrange(-20, page[1])
        out.append((i % 2, i, x, y, x + pick.randrange(side), y + pick.randrange(side)))
    return out


@pytest.mark.parametrize("dense, spread, pad", [(512, 24, 0), (1, 1000, 0), (3, 1000, 5), (2, 4, 3)])
def test_every_touching_pair_once(spark, monkeypatch, dense, spread, pad):
    monkeypatch.setattr(spatial, "DENSE", dense)
    monkeypatch.setattr(spatial, "SPREAD", spread)
    pick = random.Random(dense)
    left, right = boxes(pick, 90, 60), boxes(pick, 70, 300)
    got = spatial.touching_pairs(spark.createDataFrame(left, COLS), spark.createDataFrame(right, COLS), ["page_id"], pad).select("l_n", "r_n").collect()
    want = [(a[1], b[1]) for a in left for b in right if a[0] == b[0] and max(a[2], b[2] - pad) <= min(a[4], b[4] + pad) and max(a[3], b[3] - pad) <= min(a[5], b[5] + pad)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_dense_page_spreads_over_many_keys(spark):
    n = F.col("id")
    small = spark.range(100_000).select(F.lit(1).cast("long").alias("page_id"), (n * 7919 % 980).alias("x1"), (n * 104729 % 1380).alias("y1"))
    small = small.select("*", (F.col("x1") + 9).alias("x2"), (F.col("y1") + 9).alias("y2"))
    placed = spatial._on_grid(small, box(), 0)
    dense = spatial._dense_cells(placed, ["page_id"])
    parts = spatial._in_parts(placed, dense, ["page_id"])
    sizes = parts.groupBy("__px", "__sx", "__sy").count().agg(F.count("*"), F.max("count"), F.sum("count")).first()
    assert sizes[0] > 300 and sizes[1] < 1500 and sizes[2] < 200_000


def test_painted_pixels(spark):
    pick = random.Random(8)
    made = [(i % 3, i, x, y, x + w, y + h) for i, (x, y, w, h) in enumerate((pick.randrange(1100), pick.randrange(900), pick.choice([0, 1, 7, 200, 600]), pick.choice([-3, 1, 40, 700])) for _ in range(150))]
    made += made[:20]
    want = {}
    for page in range(3):
        bits = np.zeros((2000, 2000), bool)
        for _, _, x1, y1, x2, y2 in (b for b in made if b[0] == page and b[5] > b[3]):
            bits[y1:y2, x1:x2] = True
        want[page] = int(bits.sum())
    got = {r.page_id: r.masked_pixel_count for r in masks.masked_pixels(spark.createDataFrame(made, COLS)).collect()}
    assert got == want


def test_tiles_go_back_and_repeat_once(spark):
    tiles = spark.createDataFrame([(1, 0, 0, 1500), (1, 1, 1300, 2800), (2, 0, 0, 900)], "strip_id long, tile_no long, y1 long, y2 long")
    found = [(1, 0, 0, 10, 1310, 60, 1400, 0.8), (1, 1, 0, 10, 12, 60, 100, 0.9), (1, 1, 1, 500, 700, 600, 800, 0.5), (2, 0, 0, 10, 1, 60, 90, 0.4)]
    got = masks.strip_detections(tiles, spark.createDataFrame(found, "strip_id long, tile_no long, local_id long, x1 long, y1 long, x2 long, y2 long, score double"))
    assert sorted((r.strip_id, r.y1, r.y2, r.score) for r in got.collect()) == [(1, 1312, 1400, 0.9), (1, 2000, 2100, 0.5), (2, 1, 90, 0.4)]
