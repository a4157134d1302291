"""Quality of a text: regularised quadratic discriminant on document statistics.

Each text becomes a dozen transformed statistics. For each class, the mean and the covariance are summed up over all
labelled documents; the covariance is shrunk towards that of both classes together and towards a multiple of the
identity. The Cholesky factors are made once, and a score is the difference of the two log densities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.llm import base

STATISTICS = (
    "log_bytes", "log_words", "word_length", "upper_share", "digit_share", "symbol_share", "stop_share", "space_share",
    "distinct_words", "repeats_in_row", "distinct_lines", "longest_word", "line_words", "wide_share",
)
#: Weight of the pooled covariance and of the identity.
POOLED, IDENTITY = 0.2, 0.02
#: Log densities are divided by the number of statistics, so that scores near 0 and 1 stay apart.
SOFTEN = float(len(STATISTICS))
_KIND = np.zeros(256, np.intp)
_KIND[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
_KIND[[ord(c) for c in "0123456789"]] = 2
_KIND[[ord(c) for c in "!#$%&*+/<=>@[]\\^_`{|}~"]] = 3
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 4
_KIND[[9, 10, 11, 12, 13, 32]] = 5
_KIND[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 6
_KIND[128:] = 7


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; an empty or null text has those of no words."""
    data = (text or "").encode()
    kinds = np.zeros(8)
    for a in range(0, len(data), 1 << 20):
        kinds += np.bincount(_KIND[np.frombuffer(data[a : a + (1 << 20)], np.uint8)], minlength=8)
    size = max(len(data), 1)
    words = data.split()
    n = max(len(words), 1)
    lines = data.split(b"\n")
    in_row = sum(a == b for a, b in zip(words, words[1:]))
    share = lambda x: float(np.log((x + 0.5) / (size - x + 0.5)))
    return [
        float(np.log1p(len(data))), float(np.log1p(len(words))), float(np.log1p((size - kinds[5]) / n)), share(kinds[1]), share(kinds[2]),
        share(kinds[3]), share(kinds[4]), share(kinds[5]), float(np.log((len(set(words)) + 0.5) / (n + 0.5))), float(np.log1p(100 * in_row / n)),
        float(np.log((len(set(lines)) + 0.5) / (len(lines) + 0.5))), float(np.log1p(max(map(len, words), default=0))),
        float(np.log1p(n / len(lines))), share(kinds[7]),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """(row_id, doc_id, x): the statistics of every row."""
    base.small_batches(docs.sparkSession)
    return base.map_batches(
        base.with_row(docs, "doc_id", "text"),
        lambda b: {"row_id": b["row_id"], "doc_id": b["doc_id"], "x": [statistics(t) for t in b["text"]]},
        "row_id long, doc_id long, x array<double>",
    )


@dataclass
class Model:
    """Means, inverse Cholesky factors and log determinants of class 0 and 1; ``share`` is the share of class 1."""

    means: np.ndarray
    factors: np.ndarray
    determinants: np.ndarray
    share: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if len(self.means) < 2:
            return np.full(len(x), self.share)
        density = []
        for mean, factor, determinant in zip(self.means, self.factors, self.determinants):
            y = (x - mean) @ factor.T
            density.append(-0.5 * (y * y).sum(axis=1) - determinant)
        prior = np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0] + prior) / SOFTEN, -700, 700)))


def fit(rows: DataFrame, labels: DataFrame) -> Model:
    """Model from ``rows`` of ``measured`` and ``labels`` (doc_id, quality 0 or 1).

    Every label counts once for every document of its id; other labels and null ids are passed over. With no label all
    scores are 0.5, with one class they are that class.
    """
    votes = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id", F.col("quality").alias("label")).agg(F.count("*").alias("votes"))
    d = len(STATISTICS)

    def add_up(batches):
        import pyarrow as pa

        sums = {}
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, d)
            label, weight = batch.column("label").to_numpy(), batch.column("votes").to_numpy().astype(float)
            for k in np.unique(label).tolist():
                own, w = x[label == k], weight[label == k]
                n, s, q = sums.get(k, (0.0, 0.0, 0.0))
                sums[k] = (n + w.sum(), s + w @ own, q + (own * w[:, None]).T @ own)
        rows = [(k, i, v) for k, (n, s, q) in sums.items() for i, v in enumerate([n, *s, *q.ravel()])]
        yield pa.RecordBatch.from_pydict({"label": pa.array([r[0] for r in rows], pa.int64()), "i": pa.array([r[1] for r in rows], pa.int64()), "v": pa.array([r[2] for r in rows], pa.float64())})

    joined = rows.join(votes, "doc_id").select("x", F.col("label").cast("long").alias("label"), "votes")
    got = joined.mapInArrow(add_up, "label long, i long, v double").groupBy("label", "i").agg(F.sum("v").alias("v")).collect()  # d * d + d + 1 rows a class
    sums = {k: np.zeros(1 + d + d * d) for k in {r["label"] for r in got}}
    for r in got:
        sums[r["label"]][r["i"]] = r["v"]
    if len(sums) < 2:
        return Model(np.zeros((0, d)), np.zeros((0, d, d)), np.zeros(0), float(next(iter(sums), 0.5)))
    counts = np.array([sums[k][0] for k in (0, 1)])
    means = np.array([sums[k][1 : 1 + d] / sums[k][0] for k in (0, 1)])
    covariances = np.array([sums[k][1 + d :].reshape(d, d) / sums[k][0] - np.outer(m, m) for k, m in zip((0, 1), means)])
    pooled = np.tensordot(counts / counts.sum(), covariances, 1)
    scale = np.trace(pooled) / d or 1.0
    factors, determinants = [], []
    for c in covariances:
        shrunk = (1 - POOLED) * c + POOLED * pooled
        factor = np.linalg.cholesky((1 - IDENTITY) * shrunk + IDENTITY * (scale + 1e-9) * np.eye(d))
        factors.append(np.linalg.inv(factor))
        determinants.append(np.log(np.diag(factor)).sum())
    return Model(means, np.array(factors), np.array(determinants), float(counts[1] / counts.sum()))


def score(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``measured``."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def scored(batch, model):
        s = model.scores(np.array(batch["x"], float).reshape(-1, len(STATISTICS)))
        return {"doc_id": batch["doc_id"], "score": s, "predicted": (s >= 0.5).astype(np.int32)}

    return base.map_batches(rows.select("doc_id", "x"), scored, "doc_id long, score double, predicted int", start=lambda: sent.value)


def learnable() -> Column:
    """Labels the contract lets the model learn from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every whole text, learnt from ``labels``: one row per row of ``docs`` (doc_id, score, predicted).

    Null texts are empty ones. Repeated rows get equal scores. Other columns are not looked at.
    """
    rows = base.stage(measured(docs), "statistics")
    return score(rows, fit(rows, labels))
