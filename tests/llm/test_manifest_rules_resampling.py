"""Quality rules, resampling and the manifest on small tables with all awkward rows, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagestrata.llm import linerules, merkle, resampling

LONG = "\n".join(" ".join(f"w{(i * j) % 977}" for i in range(40)) for j in range(1, 400))
COMMON = "Read more about this at 12 places."
TEXTS = [
    None, "", " ", "\n\n", "one", "one two", "a  b \n c\t d", "Größe ÉTÉ 日本語 \x0b x", "x" * 5000, LONG, LONG, "A b c " * 40, "# $ % & | < > *",
    "same\nSame\nsame\n same\n\n", "a b a b a b a b " + " ".join(f"k{i}" for i in range(50)), "\x00\x1f nul \x7f", "ΑΒΓ ǅ " * 30,
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, digest string, lines string, row_id int, n_words int, payload string"


def made():
    rows = [(None if i == 7 else i, t, [None, "en", "de"][i % 3], None if i % 4 == 0 else ["", "b", "é"][i % 3], None if i == 3 else i, 1, "d", "l", 5, 6, "p") for i, t in enumerate(TEXTS)]
    rows += [(100 + i, f"{COMMON.upper() if i % 2 else COMMON} \nunlike {i} " + " ".join(f"{'uvxyz'[i % 5]}{k}q" for k in range(60)), "en", "b" if i < 16 else None, 3, 1, "d", "l", 5, 6, "p") for i in range(25)]
    rows += [(200 + i, COMMON.replace("12", "7") + "\n" + COMMON + "\nfew " + " ".join("abcdefgh" [k % 8] + str(k) for k in range(5)), "en", "b", 3, 1, "d", "l", 5, 6, "p") for i in range(3)]
    rows += [(300 + i, " ".join(f"v{k}" for k in range(i % 60)), "en", "hot", i, 1, "d", "l", 5, 6, "p") for i in range(320)]
    return rows + [rows[5], rows[9]]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("llm") / "docs")
    spark.createDataFrame(made(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def key(rows):
    return sorted(rows, key=repr)


def wanted_rules(rows, limit):
    shape = lambda x: re.sub(r"[ \t\x0b\f\r]+", " ", re.sub("[0-9]+", "0", x.lower())).strip(" ")
    lines = [[shape(x) for x in (r[1] or "").split("\n") if shape(x)] for r in rows]
    found = Counter((r[3], x) for r, own in zip(rows, lines) for x in set(own))
    for r, own in zip(rows, lines):
        text = r[1] or ""
        words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
        full = [x for x in text.split("\n") if re.search(r"[^ \t\n\x0b\f\r]", x)]
        grams = Counter(zip(words, words[1:], words[2:]))
        again = {k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in (i, i + 1, i + 2)}
        gone = sum(len(x) for x in own if found[(r[3], x)] > limit)
        bad = len(words) < 50 or 100 * len(again) > 50 * len(words)
        yield (r[0], len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(again), gone, bad,
               not bad and 2 * (sum(map(len, own)) - gone) >= sum(map(len, own)))


@pytest.mark.parametrize("limit, top", [(10, 10_000), (1, 10_000), (1, 2), (0, 0)])
def test_quality_rules(docs, limit, top, monkeypatch):
    monkeypatch.setattr(linerules, "TOP_LINES", top)
    got = linerules.quality_rules(docs, limit).select("doc_id", *linerules.SIGNALS, "chars_removed", "base_failed", "kept")
    assert key(map(tuple, got.collect())) == key(wanted_rules(made(), limit))


def test_cleaned_texts(docs):
    got = linerules.cleaned(docs)
    assert got.columns == docs.columns
    texts = {r.doc_id: r.text for r in got.collect()}
    kept = {w[0] for w in wanted_rules(made(), 10) if w[-1]}
    assert set(texts) == kept and 100 in texts and COMMON in texts[116]
    assert all(COMMON.lower() not in texts[i].lower() and texts[i].startswith("unlike ") for i in range(100, 116))
    assert texts[9] == LONG or 9 not in texts
    assert linerules.cleaned(docs.limit(0)).count() == 0 and linerules.quality_rules(docs.limit(0)).count() == 0


def test_hashes_and_interning():
    pick = random.Random(4)
    words = [bytes(pick.randrange(97, 100) for _ in range(pick.choice([1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 31, 32, 33, 64, 65, 200]))) for _ in range(3000)]
    data = np.frombuffer(b"".join(words) + bytes(16), np.uint8)
    size = np.array([len(w) for w in words])
    start = np.cumsum(size) - size
    assert resampling.hashes(data, start, size).tolist() == [xxhash.xxh64_intdigest(w) for w in words]
    slot, of = resampling.interned(data, start, size)
    assert len(of) == len(set(words)) and all(words[of[s]] == w for s, w in zip(slot, words))


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    monkeypatch.setattr(resampling, "hashes", lambda data, start, size: np.full(len(start), 7, np.uint64))
    words = [b"ab", b"ac", b"ab", b"abc", b"q" * 100 + b"r", b"q" * 100 + b"s", b"ac"]
    size = np.array([len(w) for w in words])
    slot, of = resampling.interned(np.frombuffer(b"".join(words) + bytes(16), np.uint8), np.cumsum(size) - size, size)
    assert len(of) == 5 and all(words[of[s]] == w for s, w in zip(slot, words))


def wanted_draw(rows, target, percent, least, most, buckets):
    def grams(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(least, most + 1) for i in range(len(words) - n + 1)]

    own = [grams(r[1]) for r in rows]
    s, t = Counter(b for _, g in own for b in g), Counter(b for x in target for b in grams(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (n_s + buckets) / ((s[b] + 1.0) * (n_t + buckets)))) for b in range(buckets)]
    out = []
    for r, (n, g) in zip(rows, own):
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = math.floor(sum(gain[b] for b in g) / len(g)) if g else 0
        out.append([r[0], len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0]))
    for k, x in enumerate(fit[: percent * len(fit) // 100]):
        x[4] = k + 1
    return [tuple(x[:5]) for x in out]


@pytest.mark.parametrize("percent, most, buckets", [(10, 1, 10_000), (55, 3, 7), (100, 1, 50)])
def test_resampling(spark, docs, percent, most, buckets, monkeypatch):
    monkeypatch.setattr(resampling, "CHUNK", 1000)
    target = [None, "", "one two V3", "w3 w4 w5 it é"]
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(docs, frame, percent, buckets=buckets, most=most).drop("n_words")
    assert key(map(tuple, got.collect())) == key(wanted_draw(made(), target, percent, 1, most, buckets))


def test_resampling_of_nothing(docs):
    assert resampling.resample(docs.limit(0), docs).count() == 0
    rows = resampling.resample(docs, docs.limit(0)).collect()
    assert len(rows) == len(made()) and sum(r.rank is not None for r in rows) == sum(r.n_words >= 20 for r in rows) // 10


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def wanted_manifest(rows):
    def leaf(r, text):
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
        return out

    def sides(tree, i):
        for nodes in tree[:-1]:
            a = i // 16 * 16
            yield "".join(nodes[a:i]), "".join(nodes[i + 1 : a + 16])
            i //= 16

    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = levels([leaf(r, r[1]) for r in groups[s]])
    top = levels([trees[s][-1][0] for s in order])
    for k, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            path = [*sides(trees[s], i), *sides(top, k)]
            forge = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            text = re.sub("[A-Z]", lambda m: m[0].lower(), r[1]) if forge and r[1] is not None else r[1]
            reached = leaf(r, text)
            for a, b in path:
                reached = digest(a + reached + b)
            yield r[0], leaf(r, r[1]), trees[s][-1][0], top[-1][0], digest("".join(a + b for a, b in path)), reached, reached == top[-1][0]


def test_manifest(docs):
    got = merkle.verified(merkle.manifest(docs)).collect()
    want = list(wanted_manifest(made()))
    assert key(map(tuple, got)) == key(want) and 0 < sum(not w[-1] for w in want) < len(want)


def test_manifest_of_many_sources_one_document_and_none(spark, docs):
    rows = [(i, f"T{i}", None, f"s{i % 300:03}", i, 1, "d", "l", 5, 6, "p") for i in range(700)]
    many = spark.createDataFrame(rows, SCHEMA)
    assert key(map(tuple, merkle.verified(merkle.manifest(many)).collect())) == key(wanted_manifest(rows))
    one = merkle.verified(merkle.manifest(many.filter("doc_id = 4"))).collect()
    assert list(map(tuple, one)) == list(wanted_manifest(rows[4:5])) and one[0].leaf == one[0].root
    assert merkle.manifest(docs.limit(0)).count() == 0


def test_proofs_need_no_join(docs):
    leaves = docs.filter("source = 'hot'").select(F.col("source").alias("grp"), F.lit(320).cast("long").alias("n"), (F.col("doc_id") - 300).alias("rank"),
                                                 F.sha2("text", 256).alias("digest"), F.struct("doc_id").alias("payload"))
    tree = merkle.grown(leaves, "test")
    assert len(tree.rounds) == 2 and max(r.n for r in tree.rounds[0].selectExpr("aggregate(transform(runs, x -> size(x.kids)), 0, (a, x) -> a + x) AS n").collect()) == 256
    crown = tree.roots.select("grp", F.array().cast(merkle.PATH).alias("path"), F.col("digest").alias("crown"))
    assert "Join" not in merkle.paths(tree, crown)._jdf.queryExecution().optimizedPlan().toString()
