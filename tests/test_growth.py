"""Work that must not grow faster than its input: one reading, one pass, one cell, many files."""

import random

import pytest
from pyspark.sql import functions as F

from pagestrata.functions import geometry as g
from pagestrata.functions.geometry import box
from pagestrata.operators import boxrules as rules
from pagestrata.operators import layouts as lo
from pagestrata.operators import spatial
from pagestrata.plans import q_layouts, q_regions, q_stages
from pagestrata.plans.fixtures import Views
from pagestrata.streaming import jobs


@pytest.fixture
def views(spark, tmp_path):
    """Line items of 40 pages in a folder of their own."""
    n = F.col("id")
    made = spark.range(1200).select(
        F.floor(n / 4).alias("l_orderkey"), (n * 37 % 501).alias("l_partkey"), (n * 11 % 97).alias("l_suppkey"), (n % 4 + 1).cast("int").alias("l_linenumber"),
        F.lit(1.0).alias("l_quantity"), n.cast("double").alias("l_extendedprice"))
    made.write.parquet(f"{tmp_path}/lineitem.parquet")
    return Views(spark, str(tmp_path))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def reads(df):
    return plan(df).count("FileScan parquet")


def test_crowds_read_the_table_once(views):
    assert reads(q_regions.crowd(views)) == reads(q_layouts.text_crowd(views)) == 1


def test_an_ordinary_box_stands_in_one_cell(spark):
    made = spark.createDataFrame([(1, 300, 100, 620, 700), (1, 0, 0, 999, 1399)], "page_id long, x1 long, y1 long, x2 long, y2 long")
    assert spatial._on_grid(made, box(), 0).count() == 2


def test_a_staged_box_is_computed_once(spark):
    made = spark.createDataFrame([(1, 3, 9, 7, 2)], "page_id long, x1 long, y1 long, x2 long, y2 long")
    cut = g.stage(made, "__k", g.clamp_swap(box(), F.lit(1000), F.lit(1400)))
    k = box("__k")
    kept = cut.where((k.width > 0) & (k.height > 0) & (g.area(k) >= 28))
    assert plan(kept).count("least(greatest(") + plan(kept).count("greatest(0") <= 24
    assert [tuple(r) for r in kept.select(*k).collect()] == [(3, 2, 7, 9)]


@pytest.mark.parametrize("most", [0, 50_000])
def test_components_and_selection_of_small_and_large_keys(spark, monkeypatch, most):
    monkeypatch.setattr(spatial, "KEY_LINKS", most)
    pick = random.Random(4)
    links = sorted({(p, *sorted(pick.sample(range(40), 2))) for p in (1, 2) for _ in range(30)})
    nodes = spark.createDataFrame([(p, n) for p in (1, 2) for n in range(40)], "page_id long, n long")
    edges = spark.createDataFrame(links, "page_id long, a long, b long")
    label = {(p, n): n for p in (1, 2) for n in range(40)}
    for _ in range(40):
        for p, a, b in links:
            label[p, a] = label[p, b] = min(label[p, a], label[p, b])
    got = spatial.connected_components(nodes, edges, ["page_id"], "n", "a", "b").collect()
    assert {(r.page_id, r.n): r.component for r in got} == label
    kept = {(p, n) for p in (1, 2) for n in range(40)}
    for n in range(40):
        kept -= {(p, n) for p in (1, 2) if any((p, a) in kept for q, a, b in links if q == p and b == n)}
    assert {(r.page_id, r.n) for r in spatial.greedy_keep(nodes, edges, ["page_id"], "n", "a", "b").collect()} == kept


def test_rules_look_at_boxes_that_meet_only(monkeypatch):
    seen = []
    monkeypatch.setattr(rules, "inter", lambda a, b, was=rules.inter: seen.append(1) or was(a, b))
    row = {"region_id": 0, "score": 0.5, "is_dark": False, "confidence": 0.5, "detector": None, "reading_order": None, "label": "", "text_key": "", "text": ""}
    for make in (rules.BubbleMerge, rules.BlockDedupe, rules.TextDedupe, rules.RoiMerge, rules.TextGeometryDedupe):
        state = make()
        for i in range(100):
            state.add({**row, "x1": 20 * i, "y1": 0, "x2": 20 * i + 10, "y2": 10})
        assert len(state.kept) == 100
    assert not seen


def test_numbered_folds_run_once(spark):
    made = spark.createDataFrame([(1, i, 10 * i, 0, 10 * i + 40, 50, 0.5, "a", None, 1000, 1400) for i in range(5)],
                                 "page_id long, region_id long, x1 long, y1 long, x2 long, y2 long, score double, label string, reading_order long, w long, h long")
    rois = lo.layout_rois(made, made.select("page_id", "w", "h").distinct(), 0)
    assert "MapInArrow" not in plan(rois)


def test_edit_logs_are_many_files(spark, views, monkeypatch, tmp_path):
    monkeypatch.setattr(q_stages, "scratch", lambda v, name: f"{tmp_path}/{name}")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        q_stages._edit_stream(views)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    log = spark.read.parquet(f"{tmp_path}/edits").withColumn("file", F.input_file_name())
    assert log.count() == sum(part.count() for part in q_stages._edit_log(views))
    assert log.select("file").distinct().count() >= 9
    # the new boxes of a page are numbered in one batch
    assert log.where("canon_id = ''").groupBy("page_id").agg(F.count_distinct("file").alias("n")).where("n > 1").count() == 0


def test_last_edits_need_no_sort(spark):
    rows = spark.createDataFrame([(1, "a", "bbox", 1, 2, 3, 4, 0), (1, "a", "bbox", 5, 6, 7, 8, 1)],
                                 "page_id long, canon_id string, field string, e_x1 long, e_y1 long, e_x2 long, e_y2 long, seq long")
    assert "SortAggregate" not in plan(jobs.edit_batch(rows))
    assert [tuple(r) for r in jobs.edit_batch(rows).collect()] == [(1, "a", "bbox", 5, 6, 7, 8, 1)]
