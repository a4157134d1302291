"""What a query holds on disk: views computed once, rows shuffled once, files compressed and given back."""

import os
import time

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pagestrata.operators import canon as cn
from pagestrata.operators import folds, ranking
from pagestrata.plans import catalog, q_stages
from pagestrata.plans.fixtures import Views
from pagestrata.session import release, saved, shared_folder
from pagestrata.streaming import jobs


@pytest.fixture
def folder(spark, tmp_path):
    """Line items of 20 pages and their parts."""
    n = F.col("id")
    spark.range(600).select(
        F.floor(n / 4).alias("l_orderkey"), (n * 37 % 251).alias("l_partkey"), (n * 11 % 97).alias("l_suppkey"), (n % 4 + 1).cast("int").alias("l_linenumber"),
        F.lit(1.0).alias("l_quantity"), n.cast("double").alias("l_extendedprice")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(251).select(n.alias("p_partkey"), *(F.concat(F.lit(c), n.cast("string")).alias(c) for c in ("p_name", "p_brand", "p_type"))).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


#: query -> readings of the line items left in its last step
READINGS = {
    "stream_edit_batches": 0, "strip_detections": 0, "canon_from_detection": 0, "resolve_overlaps": 0, "roi_detections": 0, "upgrade_canon": 1, "outside_text_blocks": 0, "edit_view": 0,
    "resolve_canon_id": 0, "sanitize_regions": 0, "ocr_edits_on_canon": 0, "edit_mask_boxes": 0, "derive_mask_boxes": 0, "scan_detection_documents": 0,
}


@pytest.mark.parametrize("name", READINGS)
def test_the_last_step_reads_what_was_kept(spark, folder, name):
    made = plan(catalog.QUERIES[name](spark, folder))
    assert made.count("l_orderkey") == 0 or made.count("lineitem.parquet") <= READINGS[name]
    assert "part.parquet" not in made and "Scan ExistingRDD" not in made


def test_a_kept_view_has_the_same_rows(spark, folder):
    v, kept = Views(spark, folder), Views(spark, folder)
    kept.keep("region")
    for name in ("region", "canon", "ocr"):
        assert sorted(map(str, getattr(v, name).collect())) == sorted(map(str, getattr(kept, name).collect()))
        assert "lineitem.parquet" not in plan(getattr(kept, name))


def test_rows_are_numbered_in_one_shuffle(spark):
    rows = [(k, b, i) for k in (1, 2, None) for i, b in enumerate([0, 0, 1, 5, None, 5, 1])]
    df = spark.createDataFrame(rows, "k long, b long, i long")
    got = ranking.with_position(df, ["k"], [F.col("b"), F.col("i")], [F.floor(F.col("b") / 2)])
    assert "Join" not in plan(got)
    want = df.withColumn("position", F.row_number().over(Window.partitionBy("k").orderBy("b", "i")).cast("long") - 1)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_saved_rows_are_compressed_and_their_shuffle_goes(spark):
    tracker = spark.sparkContext._jsc.sc().env().mapOutputTracker()
    release(spark)
    before = tracker.shuffleStatuses().size()
    kept = saved(spark.range(2000).repartition(40, "id"), "numbers")
    assert all(".zstd." in f for f in kept.inputFiles()) and kept.count() == 2000
    # the cleaner works beside it
    for _ in range(50):
        release(spark)
        if tracker.shuffleStatuses().size() <= before:
            break
        time.sleep(0.1)
    assert tracker.shuffleStatuses().size() <= before


def test_boxes_are_asked_for_items_no_name_has_found(spark, monkeypatch):
    cols = "page_id long, pos long, canon_id string, kind string, bubble_id long, region_ids array<long>, " + ", ".join(f"{p}{e} long" for p in ("", "o", "r") for e in ("x1", "y1", "x2", "y2"))
    some = lambda i, name, bubble, x: (1, i, name, "bubble", bubble, [], x, 0, x + 9, 9, x, 1, x + 9, 8, None, None, None, None)
    canon = spark.createDataFrame([some(0, "a", 7, 0), some(1, "b", 8, 50), some(2, "c", 9, 100)], cols)
    items = spark.createDataFrame([some(0, "b", 7, 100), some(1, "", 9, 0), some(2, "gone", None, 50), some(3, "gone", None, 70)], cols).withColumnRenamed("pos", "item_id")
    asked = []
    places = cn._places
    monkeypatch.setattr(cn, "_places", lambda df, c: asked.append(df.count()) or places(df, c))
    assert {r.item_id: r.match for r in cn.resolve(items, canon).collect()} == {0: 1, 1: 2, 2: 1, 3: None}
    assert sorted(asked) == [2, 3]


def test_batches_leave_no_files_of_their_own(spark, folder):
    spark.range(1).count()
    at = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(at))
    v = Views(spark, folder)
    base, out = saved(q_stages._editable(v), "base"), f"{folder}/out"
    jobs.stream_edits(q_stages._edit_stream(v), base, out, f"{folder}/mark").awaitTermination()
    left = {d.rsplit("-", 5)[0] for d in set(os.listdir(at)) - before}
    assert "base" in left and "state" not in left
    assert all(".zstd." in f for f in spark.read.parquet(f"{out}/canon").inputFiles())


def test_written_documents_are_compressed(spark, folder):
    made = Views(spark, folder).canon.groupBy("page_id").agg(F.count("*").alias("item_count"))
    path = q_stages.written(Views(spark, folder), "inpaint", made)
    assert all(f.endswith(".gz") for f in spark.read.text(path).inputFiles())


def test_columns_become_rows_as_before():
    region = pa.struct([("i", pa.int64()), ("d", pa.float64()), ("s", pa.string()), ("p", pa.list_(pa.list_(pa.int32())))])
    one = {"i": 2**60 + 1, "d": 0.1, "s": "a", "p": [[1, 2], [], None]}
    for kind, values in (
        (pa.list_(region), [[one, {**one, "i": None, "d": None}], [], None, [None, one]]), (region, [one, None]), (pa.int64(), [1, None, -(2**62)]),
        (pa.float64(), [0.5, None, float("inf")]), (pa.bool_(), [True, None]), (pa.list_(region), []), (pa.list_(pa.list_(pa.int64())), [[[1]], [[], [2, 3]]]), (pa.int32(), [3]),
    ):
        column = pa.array(values, kind)
        for part in (column, column.slice(1), column.slice(0, 1)):
            assert folds.values_of(part) == part.to_pylist()


def test_sizes_are_counted_where_it_costs_less(spark):
    df = spark.createDataFrame([(1, 2), (1, 3), (2, 4)], "k long, v long")
    broken = df.withColumn("v", F.raise_error(F.lit("not to be read")).cast("long"))
    small, big = folds.split_by_size(broken.withColumn("k", F.col("k") + F.col("v")), ["k"], 5, df)
    assert big is None and small.columns == df.columns
