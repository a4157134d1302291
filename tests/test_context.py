"""Translation with what earlier chunks have taught, in rounds and as a stream, against one page after the other."""

import re
from collections import Counter

from pyspark.sql import functions as F

from pagestrata.operators import memory, stages
from pagestrata.operators import terms as tm
from pagestrata.streaming import context

LINES = "project_id long, page_no long, line_no long, text string"


class Told:
    """Answers with the length of its context; names are taught by one page, one project runs out of quota."""

    def call(self, row):
        if row["project_id"] == 3 and row["chunk"] == 1:
            raise RuntimeError("HTTP 429 quota")
        mark = f"<{len(row['context'])}> a longer line: "
        reply = "[TERMS]\nMira → M\nMira → Mi\n[/TERMS]" if any(p["page_no"] == 1 for p in row["pages"]) else None
        return {"answers": [{"page_no": p["page_no"], "lines": [mark + x for x in p["lines"]]} for p in row["pages"]], "reply": reply}


class Never:
    def call(self, row):
        raise RuntimeError("not asked")


def words_of(text):
    found = re.findall(r"\b([A-Z][a-z]{2,})\b", text)
    return [w for w in found + text.split() if len(w) >= 2]


class Memory:
    """The rules of the memory for one project, page after page."""

    def __init__(self):
        self.counts, self.order, self.names, self.pages = Counter(), [], {}, []

    def count(self, word, by=1):
        if word not in self.counts:
            self.order.append(word)
        self.counts[word] += by

    def prompt(self):
        names = "".join(f"  {a} → {b}\n" for a, b in list(self.names.items())[:15])
        top = sorted(self.counts, key=lambda w: (-self.counts[w], self.order.index(w)))[:20]
        lines = "".join(f"  {w} → {self.names[w]}\n" if w in self.names else f"  {w} (×{self.counts[w]})\n" for w in [w for w in top if self.counts[w] >= 2][:15])
        story = [x for page in self.pages[-3:] for x in page if len(x) > 10][:3]
        body = (f"{tm.NAMES_TITLE}\n{names}" if names else "") + (f"{tm.TERMS_TITLE}\n{lines}" if lines else "") + (f"{tm.STORY_TITLE}{' | '.join(story)}...\n" if story else "")
        return f"{tm.PROMPT_START}{body}{tm.PROMPT_END}" if body else ""


def one_by_one(pages, size):
    out, memory_ = [], Memory()
    for k in range(0, len(pages), size):
        context_, chunk = memory_.prompt(), pages[k : k + size]
        spent = chunk[0][0] == 3 and k // size == 1
        for project, page, lines in chunk:
            done = [x if spent else f"<{len(context_)}> a longer line: {x}" for x in lines]
            out += [(project, page, i, y) for i, y in enumerate(done)]
            memory_.pages.append(done)
            for x, y in zip(lines, done):
                for w in words_of(x) if x and y else []:
                    memory_.count(w)
        if not spent and any(page == 1 for _, page, _ in chunk):
            memory_.names["Mira"] = "Mi"
            memory_.count("Mira", 5)
    return out, memory_


def made():
    text = ["Mira went home", "the Tower of Mira", "", "so it is so", "ok", "Tower and Tower again", "Nina met Mira there"]
    return {p: [(p, page, [text[(p + page + i) % 7] for i in range(1 + (p * page) % 3)]) for page in range(n)] for p, n in ((1, 9), (2, 1), (3, 5))}


def test_rounds_equal_one_page_after_the_other(spark):
    pages = made()
    rows = [(p, page, i, x) for own in pages.values() for p, page, lines in own for i, x in enumerate(lines)]
    done, left = stages.translate_in_context(spark.createDataFrame(rows, LINES), Told, Never, 2)
    want = [one_by_one(own, 2) for own in pages.values()]
    got = sorted((r.project_id, r.page_no, r.line_no, r.translated) for r in done.collect())
    assert got == sorted(x for out, _ in want for x in out)
    prompts = {r.project_id: r.prompt for r in memory.prompts(left).collect()}
    assert prompts == {p: m.prompt() for p, (_, m) in zip(pages, want)}
    sizes = {r.project_id: (r.tracked_words, r.character_names, r.recent_pages, r.has_summary) for r in memory.stats(left).collect()}
    assert sizes == {p: (len(m.counts), len(m.names), min(5, len(m.pages)), True) for p, (_, m) in zip(pages, want)}


def test_no_lines(spark):
    done, left = stages.translate_in_context(spark.createDataFrame([], LINES), Told, Never, 2)
    assert done.count() == 0 and left.count() == 0


def test_names_known_before(spark):
    rows = spark.createDataFrame([(1, 0, 0, "hi you"), (1, 5, 0, "Ann Ann")], LINES)
    known = spark.createDataFrame([(1, "Bo", "B", 1), (1, "Ann", "A", 0)], "project_id long, term string, translation string, slot long")
    done, left = stages.translate_in_context(rows, Told, Never, 1, known=known)
    first = f"---\nCONTEXT MEMORY:\n{tm.NAMES_TITLE}\n  Ann → A\n  Bo → B\n{tm.TERMS_TITLE}\n  Ann → A\n  Bo → B\n---\n"
    assert {r.page_no: r.translated for r in done.collect()}[0].startswith(f"<{len(first)}>")
    assert memory.prompts(left).first().prompt.count("Ann → A") == 2


def stream_rows(spark):
    rows = [(p, page, i, x, f"{x} in another tongue" if i != 1 else "", "[TERMS]\nMira → M%d\n[/TERMS]" % page if i == 0 else None, 1_700_000_000 + 60 * page)
            for own in made().values() for p, page, lines in own for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, "project_id long, page_no long, line_no long, text string, translated string, reply string, at long").withColumn("at", F.timestamp_seconds("at"))


def test_stream_equals_batch(spark, tmp_path):
    rows = stream_rows(spark)
    for part in ("page_no in (0, 3, 5)", "page_no in (1, 4)", "page_no not in (0, 1, 3, 4, 5)"):
        rows.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    context.run(context.project_memory(stream, "1 day"), str(tmp_path / "out"), str(tmp_path / "mark"))
    got = context.latest(spark, str(tmp_path / "out"))
    replies = rows.where("reply is not null").select("project_id", "page_no", F.lit(0).alias("step"), "reply")
    want = memory.merged(memory.learnt(rows, replies, 0))
    cols = ["project_id", "kind", "key", "cnt", "seen", "lines"]
    assert sorted(map(repr, got.select(cols).collect())) == sorted(map(repr, want.select(cols).collect()))
    named = lambda m: sorted(map(tuple, memory.names(m).select("project_id", "translation").collect()))
    assert named(got) == [(1, "M8"), (2, "M0"), (3, "M4")]
    assert sorted(memory.prompts(got).select("project_id").collect()) == sorted(memory.prompts(want).select("project_id").collect())
    assert sorted(map(tuple, memory.summaries(got).collect())) == sorted(map(tuple, memory.summaries(want).collect()))


def test_late_pages_are_dropped(spark, tmp_path):
    rows = stream_rows(spark).where("project_id = 1")
    for part in ("page_no in (3, 4)", "page_no = 5", "page_no = 0"):
        rows.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    context.run(context.project_memory(stream, "1 minute"), str(tmp_path / "out"), str(tmp_path / "mark"))
    pages = context.latest(spark, str(tmp_path / "out")).where("kind = 'page'")
    assert sorted(int(r.key) for r in pages.collect()) == [3, 4, 5]
