"""Rolling context of projects as a stream with keyed state.

Lines of pages arrive with their translations. Spark takes terms, names and long lines out of them; the state only adds up
counts, keeps first places and latest translations, and holds the last few pages. Terms are spread over ``PARTS`` keys of a project, so a project
with most lines is not one key. What changes in a batch is written as rows of a memory (``operators.memory``); read together,
the newest row of each key is the memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagestrata.operators import memory as mm
from pagestrata.operators import terms as tm
from pagestrata.streaming.jobs import into_batches

#: Keys over which the terms of one project are spread.
PARTS = 32
CHANGES = "project_id long, kind string, key string, cnt long, page_no long, line_no long, slot long, round long, value string, lines array<string>"


def _facts(lines: DataFrame) -> DataFrame:
    """Terms, names and long lines (``kind, key, value`` and their place) of lines ``project_id, page_no, line_no, text, translated, reply, at``."""
    filled = (F.col("text") != "") & (F.col("translated") != "")
    terms = F.transform(F.when(filled, tm.term_candidates(F.col("text"))).otherwise(F.array().cast("array<string>")), lambda t, i: F.struct(
        F.lit("term").alias("kind"), t.alias("key"), F.lit("").alias("value"), F.col("line_no").alias("line_no"), i.cast("long").alias("slot")))
    names = F.transform(tm.parse_terms(F.coalesce("reply", F.lit(""))), lambda p, i: F.struct(
        F.lit("name").alias("kind"), p["term"].alias("key"), p["translation"].alias("value"), F.lit(mm.AFTER_LINES).alias("line_no"), i.cast("long").alias("slot")))
    long_ = F.when(F.length("translated") > tm.MIN_SUMMARY_CHARS, F.col("translated"))
    page = F.array(F.struct(F.lit("page").alias("kind"), F.col("page_no").cast("string").alias("key"), long_.alias("value"), F.col("line_no").alias("line_no"), F.lit(0).cast("long").alias("slot")))
    each = lines.select("project_id", "page_no", "at", F.explode(F.concat(terms, names, page)).alias("f")).select("project_id", "page_no", "at", "f.*")
    part = F.when(F.col("kind") == "page", F.lit(-1)).otherwise(F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int"))
    return each.withColumn("part", part)


class Remember(StatefulProcessor):
    """State of one (project, part): counted terms and names, or the last pages."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.terms = handle.getMapState("terms", "key string", "cnt long, page_no long, line_no long, slot long, round long")
        self.names = handle.getMapState("names", "key string", "value string, page_no long, line_no long, slot long, last_page long, last_slot long, round long")
        self.pages = handle.getMapState("pages", "page_no long", "line_nos array<long>, texts array<string>, round long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        out = []
        for kind, step in (("term", self._count), ("name", self._name), ("page", self._page)):
            part = frame[frame["kind"] == kind].sort_values(["page_no", "line_no", "slot"])
            if len(part):
                out.extend(step(part))
        yield pd.DataFrame([(int(key[0]), *row) for row in out], columns=[c.split()[0] for c in CHANGES.split(", ")])

    def _count(self, rows):
        for key, own in rows.groupby("key", sort=False):
            first = tuple(int(x) for x in own[["page_no", "line_no", "slot"]].iloc[0])
            cnt, round_ = len(own), 0
            if self.terms.containsKey((key,)):
                old = self.terms.getValue((key,))
                cnt, first, round_ = cnt + old[0], min(first, tuple(old[1:4])), old[4] + 1
            self.terms.updateValue((key,), (cnt, *first, round_))
            yield "term", key, cnt, *first, round_, None, None

    def _name(self, rows):
        for key, own in rows.groupby("key", sort=False):
            first = tuple(int(x) for x in own[["page_no", "line_no", "slot"]].iloc[0])
            last = own.iloc[-1]
            value, at, round_ = last["value"], (int(last["page_no"]), int(last["slot"])), 0
            weight = tm.MANUAL_TERM_WEIGHT * own["page_no"].nunique()
            if self.names.containsKey((key,)):
                old = self.names.getValue((key,))
                first, round_ = min(first, tuple(old[1:4])), old[6] + 1
                if tuple(old[4:6]) > at:
                    value, at = old[0], tuple(old[4:6])
            self.names.updateValue((key,), (value, *first, *at, round_))
            yield "name", key, 0, *first, round_, value, None
            # a name is also a term, of five mentions for each page that teaches it
            cnt, place, count = weight, first, 0
            if self.terms.containsKey((key,)):
                old = self.terms.getValue((key,))
                cnt, place, count = cnt + old[0], min(first, tuple(old[1:4])), old[4] + 1
            self.terms.updateValue((key,), (cnt, *place, count))
            yield "term", key, cnt, *place, count, None, None

    def _page(self, rows):
        for page, own in rows.groupby("page_no"):
            long_ = own[own["value"].notna()]
            lines, round_ = list(zip(long_["line_no"].astype(int), long_["value"])), 0
            if self.pages.containsKey((int(page),)):
                old = self.pages.getValue((int(page),))
                lines, round_ = lines + list(zip(old[0], old[1])), old[2] + 1
            lines = sorted(lines)[: tm.SUMMARY_LINES]
            self.pages.updateValue((int(page),), ([n for n, _ in lines], [t for _, t in lines], round_))
            yield "page", str(page), 0, int(page), 0, 0, round_, None, [t for _, t in lines]
        for (page,) in sorted(self.pages.keys())[: -tm.RECENT_PAGES]:
            self.pages.removeKey((page,))

    def close(self) -> None:
        pass


def project_memory(lines: DataFrame, late: str) -> DataFrame:
    """Changed memory rows of a stream of lines with event time ``at``; lines older than ``late`` behind the newest are dropped."""
    facts = _facts(lines.withWatermark("at", late))
    return facts.groupBy("project_id", "part").transformWithStateInPandas(Remember(), CHANGES, "Update", "EventTime")


def run(changes: DataFrame, out: str, checkpoint: str) -> None:
    """Write the changes batch by batch until all that is there is read."""
    spark = changes.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        into_batches(changes, out, checkpoint, lambda b: b, "update").awaitTermination()
    finally:
        spark.conf.set(key, before)


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The memory that the written changes add up to: the newest row of each key, and the last pages only."""
    rows = spark.read.schema(f"{CHANGES}, batch long").parquet(out)
    keep = ["cnt", "page_no", "line_no", "slot", "value", "lines"]
    one = rows.groupBy("project_id", "kind", "key").agg(F.max_by(F.struct(*keep), F.struct("round", "batch")).alias("r"), F.max("round").alias("round"))
    rows = one.select("project_id", "kind", "key", F.col("r.cnt").alias("cnt"), F.struct("r.page_no", "r.line_no", "r.slot").alias("seen"), "round", F.col("r.value").alias("value"), F.col("r.lines").alias("lines"))
    newest = Window.partitionBy("project_id").orderBy(F.col("seen.page_no").desc())
    pages = rows.where("kind = 'page'").withColumn("n", F.row_number().over(newest)).where(F.col("n") <= tm.RECENT_PAGES).drop("n")
    return rows.where("kind <> 'page'").unionByName(pages)
