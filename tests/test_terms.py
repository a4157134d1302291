"""Terms known before each chunk, against counting them one by one."""

import random
from collections import defaultdict

import pytest

from pagestrata.operators import terms as tm


@pytest.mark.parametrize("fan, n", [(2, 3), (3, 1), (16, 4)])
def test_terms_before_every_chunk(spark, monkeypatch, fan, n):
    monkeypatch.setattr(tm, "FAN", fan)
    rnd = random.Random(fan)
    rows = [(p, page, line, 0, "abcdefghijkl"[int(12 * rnd.random() ** 2)])
            for p, pages in ((1, 23), (2, 1), (3, 40)) for page in range(pages) for line in range(rnd.randrange(4))]
    pages = [(p, page, page // 2) for p, k in ((1, 23), (2, 1), (3, 40)) for page in range(k)]
    got = tm.terms_before(
        spark.createDataFrame(rows, "project_id long, page_no long, line_no long, slot int, term string"),
        spark.createDataFrame(pages, "project_id long, page_no long, chunk long"), n)
    want = []
    for p, chunk in sorted({(p, c) for p, _, c in pages}):
        known = defaultdict(list)
        for q, page, line, slot, term in rows:
            if q == p and page // 2 < chunk:
                known[term].append((page, line, slot))
        best = sorted(known.items(), key=lambda x: (-len(x[1]), min(x[1])))[:n]
        want += [(p, chunk, t, len(at), i) for i, (t, at) in enumerate(best, 1)]
    assert sorted((r.project_id, r.chunk, r.term, r.cnt, r["rank"]) for r in got.collect()) == sorted(want)


def test_no_lines_no_terms(spark):
    rows = spark.createDataFrame([], "project_id long, page_no long, line_no long, slot int, term string")
    chunks = spark.createDataFrame([(1, 0, 0)], "project_id long, page_no long, chunk long")
    assert tm.terms_before(rows, chunks).count() == 0


@pytest.mark.parametrize("run", [1, 2, 256])
def test_running_usage_over_runs_of_pages(spark, monkeypatch, run):
    monkeypatch.setattr(tm, "RUN_PAGES", run)
    rnd = random.Random(run)
    rows = [(p, page, line, 0, rnd.choice("abc")) for p in (1, 2) for page in range(9) for line in range(rnd.randrange(3))]
    got = tm.running_term_usage(spark.createDataFrame(rows, "project_id long, page_no long, line_no long, slot int, term string"))
    uses = lambda p, t, test: sum(r[0] == p and r[4] == t and test(r[1]) for r in rows)
    want = {(p, page, t, uses(p, t, lambda x: x == page), uses(p, t, lambda x: x < page)) for p, page, _, _, t in rows}
    assert sorted(map(tuple, got.select("project_id", "page_no", "term", "cnt", "known_before").collect())) == sorted(want)
