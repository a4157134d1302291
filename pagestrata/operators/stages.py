"""Distributed jobs around model calls: work lists, batching, recovery, error rows.

A provider is any picklable object with ``call(row) -> dict`` and, if it likes,
``validate()`` and ``close()``. It is built once per task from a factory. A failing item
or provider becomes an error row; the job itself does not fail.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagestrata.functions.text import QUOTA_MARKERS, filter_ocr_text, is_quota_error
from pagestrata.operators import memory as mm
from pagestrata.operators import translation as tr
from pagestrata.operators.status import ocr_work_list, work_pages
from pagestrata.session import cut_lineage, saved


class GaveUp(Exception):
    """No attempt succeeded."""


class Retrying:
    """Calls a provider up to ``attempts`` times with doubling waits; a quota error ends it."""

    def __init__(self, provider, attempts: int = 3, base_delay: float = 1.0, sleep: Callable[[float], None] = time.sleep):
        self.provider, self.attempts, self.base_delay, self.sleep = provider, attempts, base_delay, sleep
        self.log: list[tuple[int, str]] = []

    def validate(self):
        getattr(self.provider, "validate", lambda: None)()

    def close(self):
        getattr(self.provider, "close", lambda: None)()

    def call(self, row):
        self.log = []
        for attempt in range(self.attempts):
            try:
                return self.provider.call(row)
            except Exception as exc:
                self.log.append((attempt + 1, "request timed out" if isinstance(exc, TimeoutError) else str(exc) or type(exc).__name__))
                if any(word in str(exc).lower() for word in QUOTA_MARKERS):
                    break
                if attempt + 1 < self.attempts:
                    self.sleep(self.base_delay * 2**attempt)
        raise GaveUp(self.log[-1][1])


TRIES = T.ArrayType(T.StructType().add("attempt", T.IntegerType()).add("error", T.StringType()))


def run_provider(df: DataFrame, make: Callable[[], object], result: T.StructType, attempts: int = 1, base_delay: float = 1.0) -> DataFrame:
    """Each row with the provider's result fields, ``ok``, ``error`` and ``tries``, the attempts that failed."""
    outcome = T.StructType().add("ok", T.BooleanType()).add("error", T.StringType()).add("tries", TRIES)
    schema = T.StructType([*df.schema.fields, *result.fields, *outcome.fields])
    arrow, names = to_arrow_schema(schema), result.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider, broken = None, None
        try:
            provider = Retrying(make(), attempts, base_delay)
            provider.validate()
        except Exception as exc:
            broken = f"provider unavailable: {exc}"
        try:
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    error, answer = broken, {}
                    if error is None:
                        try:
                            answer = provider.call(row)
                        except GaveUp as exc:
                            error = str(exc)
                    tries = [] if broken else [{"attempt": n, "error": text} for n, text in provider.log]
                    out.append({**row, **{n: answer.get(n) for n in names}, "ok": error is None, "error": error or "", "tries": tries})
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        finally:
            if provider is not None:
                provider.close()

    return df.mapInArrow(run, schema)


# ---------------------------------------------------------------- detection and images

BOX_RESULT = T.StructType().add("boxes", T.ArrayType(
    T.StructType().add("x1", T.LongType()).add("y1", T.LongType()).add("x2", T.LongType()).add("y2", T.LongType())
    .add("score", T.DoubleType()).add("label", T.StringType())))


def detect_pages(pages: DataFrame, reusable: DataFrame, make: Callable[[], object], force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Boxes of the pages without a usable stored result, and one outcome row per page."""
    done = run_provider(work_pages(pages, reusable, force), make, BOX_RESULT)
    boxes = done.where("ok").select("page_id", F.posexplode("boxes").alias("region_id", "b")).select(
        "page_id", F.col("region_id").cast("long").alias("region_id"), "b.*")
    outcome = done.select("page_id", F.when(F.col("ok"), "done").otherwise("error").alias("status"), "error", F.coalesce(F.size("boxes"), F.lit(0)).cast("long").alias("raw_detections"))
    return boxes, outcome


IMAGE_RESULT = T.StructType().add("image", T.BinaryType())


def image_job(pages: DataFrame, boxes: DataFrame, make: Callable[[], object], reusable: DataFrame | None = None) -> DataFrame:
    """Inpaint or render: pages with boxes go to the kernel, the others pass through.

    An image is one unit of work, so its boxes travel with it. Adds ``image, status``.
    """
    todo = pages if reusable is None else pages.join(reusable, "page_id", "left_anti")
    packed = boxes.groupBy("page_id").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("page_boxes"))
    df = todo.join(packed, "page_id", "left")
    passed = df.where(F.col("page_boxes").isNull()).select("page_id", F.col("content").alias("image"), F.lit("no_text").alias("status"), F.lit("").alias("error"))
    made = run_provider(df.where(F.col("page_boxes").isNotNull()), make, IMAGE_RESULT)
    return made.select("page_id", "image", F.when(F.col("ok"), "done").otherwise("error").alias("status"), "error").unionByName(passed)


# ---------------------------------------------------------------- recognition

TEXT_RESULT = T.StructType().add("raw_text", T.StringType())


def recognise_items(items: DataFrame, make: Callable[[], object], force: bool = False) -> DataFrame:
    """Open items recognised and judged; the status tells done, skipped with a reason, or error."""
    answered = run_provider(ocr_work_list(items, force).drop("error"), make, TEXT_RESULT)
    judged = filter_ocr_text(answered, F.col("raw_text"), F.col("provider"))
    ok = F.col("ok")
    return judged.withColumns({
        "status": F.when(~ok, "error").when(F.col("rejected"), "skipped").otherwise("done"),
        "text": F.when(ok, F.col("clean_text")).otherwise(F.col("text")), "skip_reason": F.when(ok, F.col("reason")).otherwise(""),
        "raw_ocr_text": F.when(ok & (F.col("clean_text") != F.col("raw_text")), F.col("raw_text")).otherwise(""), "needs_ocr": ~ok,
    }).drop("ok", "tries", "raw_text", "clean_text", "rejected", "reason")


# ---------------------------------------------------------------- translation

PAGES_RESULT = T.StructType().add("answers", T.ArrayType(
    T.StructType().add("page_no", T.LongType()).add("lines", T.ArrayType(T.StringType())))).add("reply", T.StringType())
LINES_RESULT = T.StructType().add("lines", T.ArrayType(T.StringType()))
TOLD = ["answers", "reply", "ok", "error"]


def _packed(lines: DataFrame, keys: Sequence[str], context: DataFrame | None = None) -> DataFrame:
    """Requests of a few pages each: ``pages`` is an array of page number and lines, ``context`` what is known of the project."""
    texts = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    pages = lines.groupBy(*dict.fromkeys([*keys, *tr.PAGE])).agg(texts.alias("lines"))
    packed = pages.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("page_no", "lines"))).alias("pages"))
    if context is None:
        return packed.withColumn("context", F.lit(""))
    return packed.join(context.select("project_id", F.col("prompt").alias("context")), "project_id", "left").na.fill("", ["context"])


def _answers(done: DataFrame) -> DataFrame:
    pages = done.where("ok").select("project_id", F.explode("answers").alias("a"))
    return pages.select("project_id", "a.page_no", F.posexplode("a.lines").alias("line_no", "text")).withColumn("line_no", F.col("line_no").cast("long"))


def _split(lines: DataFrame, answers: DataFrame, how: str) -> tuple[DataFrame, DataFrame]:
    """Lines of well-shaped pages with their answer, and lines of the failed pages."""
    fine = tr.page_shapes(lines, answers).where("valid").select(*tr.PAGE)
    good = lines.join(fine, tr.PAGE, "left_semi").join(answers.withColumnRenamed("text", "translated"), tr.LINE).withColumn("recovered_by", F.lit(how))
    return good, lines.join(fine, tr.PAGE, "left_anti")


def _spent(done: DataFrame) -> DataFrame:
    """Requests that ended because the quota is used up."""
    return done.where(~F.col("ok") & is_quota_error(F.col("error")))


def _ladder(lines: DataFrame, chunks: DataFrame, make_pages, make_lines, attempts: int, base_delay: float, context: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Lines with ``translated, recovered_by``, and the replies of the page requests (``project_id, page_no, step, reply``)."""
    ask = lambda rows, make, result: run_provider(rows, make, result, attempts, base_delay)
    batched = cut_lineage(ask(_packed(lines.join(chunks, tr.PAGE), ["project_id", "chunk"], context), make_pages, PAGES_RESULT).select(
        "project_id", "chunk", F.col("pages")[0]["page_no"].alias("page_no"), *TOLD))
    good, open_ = _split(lines, _answers(batched), "batch")
    spent = chunks.join(_spent(batched).select("project_id", "chunk"), ["project_id", "chunk"]).select(*tr.PAGE)
    alone = cut_lineage(ask(_packed(open_.join(spent, tr.PAGE, "left_anti"), tr.PAGE, context), make_pages, PAGES_RESULT).select(*tr.PAGE, *TOLD))
    good_2, open_2 = _split(open_, _answers(alone), "page")
    spent = spent.unionByName(_spent(alone).select(*tr.PAGE))
    asked = _packed(open_2.join(spent, tr.PAGE, "left_anti"), tr.PAGE).select(*tr.PAGE, F.col("pages")[0]["lines"].alias("source_lines"))
    single = ask(asked, make_lines, LINES_RESULT)
    told = cut_lineage(single.where("ok").select(*tr.PAGE, F.posexplode("lines").alias("line_no", "text")).withColumn("line_no", F.col("line_no").cast("long")))
    fine = tr.page_shapes(open_2, told).select(*tr.PAGE, F.when(F.col("valid"), "lines").otherwise("original").alias("recovered_by"))
    rest = tr.repair_lines(open_2, told).join(fine, tr.PAGE)
    cols = [*tr.LINE, "text", "translated", "recovered_by"]
    reply = lambda done, step: done.where("ok").select(*tr.PAGE, F.lit(step).alias("step"), "reply")
    return good.select(cols).unionByName(good_2.select(cols)).unionByName(rest.select(cols)), reply(batched, 0).unionByName(reply(alone, 1))


def translate_pages(
    lines: DataFrame, make_pages: Callable[[], object], make_lines: Callable[[], object], size: int | None = None, attempts: int = 1, base_delay: float = 1.0,
) -> DataFrame:
    """Every line translated: strict page batches, failed pages alone, then line batches,
    and last the originals in place of what is missing. ``recovered_by`` tells the step.

    Each request is tried up to ``attempts`` times. Pages that meet a used-up quota keep their originals at once.
    """
    lines = cut_lineage(lines.select(*tr.LINE, "text"))
    chunks = tr.page_chunks(lines.select(*tr.PAGE).distinct(), size).select(*tr.PAGE, "chunk")
    return _ladder(lines, chunks, make_pages, make_lines, attempts, base_delay)[0]


def translate_in_context(
    lines: DataFrame, make_pages: Callable[[], object], make_lines: Callable[[], object], size: int | None = None, attempts: int = 1, base_delay: float = 1.0,
    known: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """As ``translate_pages``, each chunk with what the chunks before have taught, and the memory of every project at its end.

    A wavefront over all projects: round k asks the k-th chunk of every project at once, takes up the answers into the memory and
    hands it to round k + 1. Answers depend on earlier answers, so the rounds, as many as the longest project has chunks, cannot
    run side by side; inside a round all projects do. Page requests see the context, line batches do not. ``known`` may hold names to begin
    with (``project_id, term, translation``, and ``slot`` for their order). Every round is written, so a lost executor repeats no
    earlier request; projects without a further chunk leave the memory that is rolled forward.
    """
    pages = tr.page_chunks(lines.select(*tr.PAGE).distinct(), size).select(*tr.PAGE, "chunk")
    asked = saved(lines.select(*tr.LINE, "text").join(pages, tr.PAGE), "wave", "chunk")
    last = asked.agg(F.max("chunk")).first()[0]
    ends = cut_lineage(asked.groupBy("project_id").agg(F.max("chunk").alias("last")))
    memory = cut_lineage(mm.given_names(known) if known is not None else mm.empty(lines.sparkSession))
    parts, left = [], []
    for k in range(-1 if last is None else last + 1):
        own = asked.where(F.col("chunk") == k)
        chunks = own.select(*tr.PAGE, "chunk").distinct()
        done, replies = _ladder(own.drop("chunk"), chunks, make_pages, make_lines, attempts, base_delay, mm.prompts(memory))
        done = saved(done, "wave-done")
        parts.append(done)
        grown = cut_lineage(mm.merged(memory.unionByName(mm.learnt(done, replies, k))))
        left.append(grown.join(ends.where(F.col("last") == k), "project_id", "left_semi"))
        memory = grown.join(ends.where(F.col("last") > k), "project_id", "left_semi")
    if not parts:
        return lines.select(*tr.LINE, "text", F.lit(None).cast("string").alias("translated"), F.lit("").alias("recovered_by")), memory
    return reduce(DataFrame.unionByName, parts), reduce(DataFrame.unionByName, left)


# ---------------------------------------------------------------- several stages


def run_stages(pages: DataFrame, stages: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]], scope: str = "chapter") -> tuple[DataFrame, DataFrame]:
    """Run stages in order. Each returns ``page_id, status, error``; a page that fails leaves
    the later stages. Scope 'current' stops at the first failure, 'chapter' goes on.

    Returns the outcome rows and the failures with their stage.
    """
    outcomes, failures, open_ = None, None, pages
    for name, stage in stages:
        out = cut_lineage(stage(open_).select("page_id", F.lit(name).alias("stage"), "status", "error"))
        outcomes = out if outcomes is None else outcomes.unionByName(out)
        failed = out.where("status = 'error'")
        failures = failed if failures is None else failures.unionByName(failed)
        if scope == "current" and not failed.isEmpty():
            break
        open_ = tr.without_failed(open_, failed)
    return outcomes, failures
