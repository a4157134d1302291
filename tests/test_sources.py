"""Reading and writing of documents, images and stage tables."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from pagestrata.operators import masks, stages
from pagestrata.sources import documents as docs
from pagestrata.sources import images
from pagestrata.streaming import jobs


def put(folder, name, value):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")


def test_images(spark, tmp_path):
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + struct.pack(">II", 640, 480)
    for name, data in (("a/p.png", png), ("b/p.png", b"short"), ("c/x.JPG", b"x"), ("d/no.txt", b"")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    w, h = images.png_size(F.col("content"))
    rows = images.scan_page_images(spark, str(tmp_path)).select("import_name", w.alias("w"), h.alias("h")).collect()
    assert sorted(map(tuple, rows)) == [("p.png", 640, 480), ("p_1.png", 0, 0), ("x.JPG", 0, 0)]


def test_detection_documents(spark, tmp_path):
    put(tmp_path, "p1.json", {"stage": "detection", "image_width": 10, "image_height": 20, "bubbles": [{"id": 3, "bbox": [1, 2, 3, 4]}, {"bbox": [0, 0, 5, 5], "excluded": True}],
                              "layout_regions": [], "text_regions": [{"old": 1}], "canon_state": {"schema_version": 2, "items": [{"canon_id": "item_0000"}]}})
    put(tmp_path, "p2.json", {"stage": "ocr"})
    put(tmp_path, "p3.json", "{broken")
    got = docs.scan_detection(spark, str(tmp_path))
    assert got["documents"].count() == 1 and got["rejected"].count() == 2
    assert [(r.id, r.excluded) for r in got["bubbles"].orderBy("slot").collect()] == [(3, False), (1, True)]
    item = got["canon_items"].first()
    assert (item.page_key, item.enabled, item.kind, item.manual) == ("p1", True, "layout_text", False)


@pytest.mark.parametrize("stage, status", [("ocr", "prepared"), ("translation", "pending"), ("render", "pending")])
def test_item_defaults(spark, tmp_path, stage, status):
    put(tmp_path, "a.json", {"stage": stage, "items": [{"canon_id": "item_0001"}, {"id": 9, "status": "done", "unknown": 1}]})
    items = docs.scan_items(spark, str(tmp_path), stage)["items"].orderBy("slot").collect()
    assert [(r.id, r.status, r.excluded) for r in items] == [(0, status, False), (9, "done", False)]


def test_inpaint_and_project(spark, tmp_path):
    put(tmp_path / "i", "a.json", {"stage": "inpaint", "status": "done", "settings": {"k": "v"}, "text_mask_hash": "h"})
    assert docs.scan_inpaint(spark, str(tmp_path / "i"))["documents"].first().settings == {"k": "v"}
    put(tmp_path / "p", "project.json", {"name": "n", "pages": [{"source_path": "/x/a.png", "stages": {"ocr": {"status": "done"}}}, {"source_path": "source/a.png"}, {"source_path": "b.png"}]})
    pages = docs.scan_project(spark, str(tmp_path / "p"))
    assert sorted((r.source_path, r.slot) for r in pages.collect()) == [("source/a.png", 0), ("source/b.png", 2)]
    assert docs.page_stages(pages).first().status == "done"
    put(tmp_path / "q", "project.json", {"name": "n", "source_images": ["z.png", " "]})
    assert [r.source_path for r in docs.scan_project(spark, str(tmp_path / "q")).collect()] == ["source/z.png"]


def test_stage_partitions_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    docs.write_stage(spark.createDataFrame([(1, "a"), (2, "b")], "project_id int, x string"), "ocr", path)
    docs.write_stage(spark.createDataFrame([(2, "c")], "project_id int, x string"), "ocr", path)
    assert sorted(r.x for r in docs.read_stage(spark, "ocr", path).collect()) == ["a", "c"]


def test_events(spark, tmp_path):
    put(tmp_path, "e.json", '{"command_id": "c", "event": "page_done", "page_index": 2}\n{"command_id": "d"}')
    assert docs.scan_events(spark, str(tmp_path)).where("event is null").first().command_id == "d"


class Flaky:
    def __init__(self, errors):
        self.errors = list(errors)

    def call(self, row):
        if self.errors:
            raise RuntimeError(self.errors.pop(0))
        return {"v": 1}


def test_retries():
    waits = []
    ok = stages.Retrying(Flaky(["bad json", "bad json"]), 3, 0.5, waits.append)
    assert ok.call({}) == {"v": 1} and waits == [0.5, 1.0]
    with pytest.raises(stages.GaveUp):
        stages.Retrying(Flaky(["HTTP 429", "x"]), 3, 0.5, waits.append).call({})
    assert waits == [0.5, 1.0]
    with pytest.raises(stages.GaveUp):
        stages.Retrying(Flaky(["a", "b", "c"]), 3, 0.1, waits.append).call({})


class Busy:
    """Projects 1 to 3: fails twice, has no quota, answers."""

    def __init__(self):
        self.seen = 0

    def call(self, row):
        self.seen += 1
        if row["project_id"] == 1 and self.seen < 3:
            raise RuntimeError("bad json")
        if row["project_id"] == 2:
            raise RuntimeError("HTTP 429")
        return {"answers": [{"page_no": p["page_no"], "lines": [x.upper() for x in p["lines"]]} for p in row["pages"]]}


class Never:
    def call(self, row):
        return {"lines": ["asked"]}


def test_attempts_are_rows_and_a_used_up_quota_keeps_originals(spark):
    lines = spark.createDataFrame([(p, 0, 0, f"t{p}") for p in (1, 2, 3)], "project_id long, page_no long, line_no long, text string")
    got = {r.project_id: (r.translated, r.recovered_by) for r in stages.translate_pages(lines, Busy, Never, 2, attempts=3, base_delay=0.01).collect()}
    assert got == {1: ("T1", "batch"), 2: ("t2", "original"), 3: ("T3", "batch")}
    one = lines.where("project_id < 3").withColumn("pages", F.array(F.struct("page_no", F.array("text").alias("lines")))).repartition(2, "project_id")
    done = stages.run_provider(one, Busy, stages.PAGES_RESULT, 3, 0.01).collect()
    tries = {r.project_id: [(t.attempt, t.error) for t in r.tries] for r in done}
    assert tries[2] == [(1, "HTTP 429")] and all(e == "bad json" for _, e in tries[1])


class Down:
    def validate(self):
        raise RuntimeError("no server")

    def call(self, row):
        return {}


def test_provider_that_does_not_start_gives_error_rows(spark):
    df = spark.createDataFrame([(1,), (2,)], "page_id long")
    boxes, outcome = stages.detect_pages(df, df.where("page_id = 2"), Down)
    assert boxes.count() == 0 and [(r.page_id, r.status) for r in outcome.collect()] == [(1, "error")]


def test_current_scope_stops_at_first_failure(spark):
    pages = spark.createDataFrame([(1,), (2,)], "page_id long")
    step = lambda bad: lambda p: p.select("page_id", F.when(F.col("page_id") == bad, "error").otherwise("done").alias("status"), F.lit("").alias("error"))
    for scope, rows in (("current", 2), ("chapter", 3)):
        out, failures = stages.run_stages(pages, [("a", step(1)), ("b", step(9))], scope)
        assert out.count() == rows and failures.count() == 1


def test_mask_signature_ignores_order(spark):
    cols = "page_id long, w int, h int, x1 int, y1 int, x2 int, y2 int"
    a = [(1, 9, 9, 0, 0, 2, 2), (1, 9, 9, 3, 3, 5, 5)]
    sig = lambda rows: masks.mask_signature(spark.createDataFrame(rows, cols)).first().signature
    assert sig(a) == sig(a[::-1] + a) != sig(a[:1]) and sig(a) != sig([(1, 8, *r[2:]) for r in a])


def test_windows_close_behind_the_watermark(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("2024-01-01 00:01:00", "c", "ocr"), ("2024-01-01 00:02:00", "c", "ocr"), ("2024-01-01 03:00:00", "c", "ocr")]
    df = spark.createDataFrame(rows, "ts string, command_id string, stage string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(src)
    stream = jobs.progress_windows(spark.readStream.schema(df.schema).parquet(src))
    out = str(tmp_path / "out")
    jobs.into_batches(stream, out, str(tmp_path / "mark"), lambda b: b.select("reports")).awaitTermination()
    assert [r.reports for r in spark.read.parquet(out).collect()] == [2]


def test_unknown_fields_stay(spark, tmp_path):
    put(tmp_path, "a.json", {"stage": "ocr", "note": {"by": "x"}, "image_width": "odd", "items": [{"canon_id": "c", "id": 4, "bbox": "none", "k": [1, None]}, {"canon_id": "d"}, 7]})
    read = docs.scan_items(spark, str(tmp_path), "ocr")
    doc = read["documents"].select("image_width", F.to_json("extra").alias("extra")).first()
    assert (doc.image_width, json.loads(doc.extra)) == (None, {"note": {"by": "x"}})
    items = [(r.canon_id, r.bbox, r.extra) for r in read["items"].select("slot", "canon_id", "bbox", F.to_json("extra").alias("extra")).orderBy("slot").collect()]
    assert items[:2] == [("c", None, '{"k":[1,null]}'), ("d", None, None)]
    from pagestrata.operators.export import page_documents

    made = page_documents(read["items"].select(F.lit(1).alias("page_id"), "id", "canon_id", "extra"), ["canon_id"], "extra").first().document
    assert json.loads(made)[:2] == [{"id": 0, "canon_id": "d"}, {"id": 1, "canon_id": ""}] or {"id": 0, "canon_id": "d"} in json.loads(made)
    assert {"k": [1, None]}.items() <= next(x for x in json.loads(made) if x["canon_id"] == "c").items()


def test_index_is_clamped(spark, tmp_path):
    for name, index in (("a", 9), ("b", -2), ("c", None)):
        put(tmp_path / name, "project.json", {"name": name, "current_page_index": index, "pages": [{"source_path": "x.png"}, {"source_path": "y.png"}]})
    for name, want in (("a", 1), ("b", 0), ("c", 0)):
        assert {r.current_page_index for r in docs.scan_project(spark, str(tmp_path / name)).collect()} == {want}


def test_results_at_any_depth(spark):
    from pagestrata.operators.recognition import flatten_output

    deep = {"rec_texts": ["One", "two", "", 3], "rec_scores": [0.9, "bad", 1, 0.2], "dt_polys": [[[0, 0], [4, 0], [4, 8], [0, 8]], [[1, 1]], [], [[2, 2]]]}
    for k in range(20):
        deep = [deep, {"x": None}] if k % 2 else {"page": deep, "rec_scores": [{"rec_texts": ["not here"]}]}
    rows = [(1, json.dumps(deep)), (2, "{broken"), (3, json.dumps([[{"res": {"rec_texts": ["A"], "rec_scores": [0.5], "rec_boxes": [[0, 0, 2, 6]]}}, {"rec_texts": ["a"], "rec_scores": [0.7], "rec_boxes": [[[0, 0], [8, 4]]]}]])),
            (4, json.dumps({"pages": [{"text_lines": [{"text": "l", "bbox": [3, 4, 9, 9]}, {"text": " "}]}]})), (5, None), (6, "7")]
    got = flatten_output(spark.createDataFrame(rows, "crop_id long, j string"), F.col("j"), 0.3)
    assert sorted((r.crop_id, r.text, r.score, r.cx, r.cy) for r in got.collect()) == [(1, "One", 0.9, 2.0, 4.0), (1, "two", 1.0, 1.0, 1.0), (3, "a", 0.7, 4.0, 2.0), (4, "l", 1.0, 3.0, 4.0)]


def test_images_are_done_again_with_other_settings_only(spark, tmp_path):
    folder = tmp_path / "pages"
    put(folder, "a.png", "one")
    put(folder, "b.png", "two")
    keys = ["length", "threshold"]
    none = spark.createDataFrame([], "path string, length long, threshold int")

    def run(name, threshold, stored):
        out = str(tmp_path / name)
        pages = jobs.image_stream(spark, str(folder)).withColumn("threshold", F.lit(threshold))
        jobs.stage_new_pages(pages, stored, keys, lambda open_: open_.select("path", *keys, F.lit("done").alias("status")), f"{out}/rows", f"{out}/mark").awaitTermination()
        done = spark.read.schema("path string, length long, threshold int, status string").parquet(f"{out}/rows")
        return done, sorted(r.path.rsplit("/", 1)[1] for r in done.collect())

    assert run("first", 1, none)[1] == ["a.png", "b.png"]
    put(folder, "c.png", "new")
    first, names = run("first", 1, none)
    assert names == ["a.png", "b.png", "c.png"]
    assert run("same", 1, first)[1] == []
    assert run("other", 2, first)[1] == ["a.png", "b.png", "c.png"]


def test_removed_rows_reach_the_trash_once(spark, tmp_path):
    from pagestrata.operators import status

    pages = spark.createDataFrame([(1, 10, 0, "source/a.png"), (1, 11, 1, "source/b.png")], "project_id long, page_id long, page_no long, source_path string")
    stored = status.artefacts(pages, (("ocr", ".json"),))
    asked = spark.createDataFrame([(1, 0, "source/a.png"), (1, 1, "source/a.png"), (1, 2, "none")], "project_id long, slot long, path string")
    outcome = status.removal(asked, pages)
    for _ in range(2):  # a replay writes the same rows
        left, files = status.remove_pages(outcome, pages, stored, str(tmp_path / "trash"), "7")
        assert [r.page_id for r in left.collect()] == [11] and [r.path for r in files.collect()] == ["cache/ocr/b.json"]
    trash = spark.read.parquet(str(tmp_path / "trash")).collect()
    assert sorted((r.kind, r.trash_path) for r in trash) == [("ocr", "trash/cache/ocr/10_a.json"), ("page", "trash/pages/10_a.png")]


def test_replayed_edits_change_nothing(spark, tmp_path):
    base = spark.createDataFrame([(1, "item_0000", "bubble", True, False, 0, 0, 9, 9, 100, 100)], "page_id long, canon_id string, kind string, enabled boolean, excluded boolean, x1 long, y1 long, x2 long, y2 long, w long, h long")
    for p in "or":
        base = base.withColumns({f"{p}{e}": F.col(e) for e in ("x1", "y1", "x2", "y2")})
    base = base.withColumns({f: F.lit(False) for f in ("manual", "bbox_edited", "ocr_edited", "render_edited")})
    cols = "page_id long, slot long, canon_id string, kind string, x1 long, y1 long, x2 long, y2 long, excluded boolean, w long, h long"
    edits = [[(1, 1, "item_0000", "bubble", 5, 5, 30, 30, False, 100, 100)], [(1, 2, "", "bubble", 50, 50, 90, 90, False, 100, 100)], [(1, 3, "item_0001", "bubble", 40, 50, 90, 90, True, 100, 100)]]
    for rows in edits:
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for mark in ("m1", "m2"):  # the second query starts at batch 0 again, over what the first has written
        stream = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        jobs.stream_edits(stream, base, out, str(tmp_path / mark)).awaitTermination()
        got = sorted((r.canon_id, r.x1, r.enabled, r.manual) for r in jobs.page_state(spark, base, out).collect())
        assert got == [("item_0000", 5, True, False), ("item_0001", 40, False, True)]
        assert {(r.stage, r.mark) for r in jobs.edit_marks_of(spark, out).collect()} == {("detection", "edited"), *((s, "stale") for s in ("ocr", "translation", "inpaint", "render", "export"))}
