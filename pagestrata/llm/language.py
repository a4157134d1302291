"""Language of a text: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes a space, and the n-grams of 1 to 3 characters are hashed to
``DIMENSION`` features. Document frequencies come from all documents that may be learnt from. The weights are trained by
follow-the-regularised-leader with an L1 and an L2 penalty on a sample of at most ``TRAIN_ROWS`` labelled rows per
language, whole texts; a fifth of it is held back, and one temperature is fitted there so that scores are probabilities.
Every language that has a row is learnt. Vectors and weights in training lie in files of the task, so that its memory does
not grow with the languages.
"""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.llm import base

DIMENSION, ORDERS = 1 << 15, 3
#: Rows learnt from per language.
TRAIN_ROWS = 750
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 1e-4, 1e-5
#: Characters that are counted at a time.
CHUNK = 1 << 18
#: Features whose weights are sent at a time.
BLOCK = 1 << 10
UNKNOWN = "und"
_SPACE = np.array([32], np.uint32)
_SHIFT = np.uint32(32 - DIMENSION.bit_length() + 1)
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def _letters() -> np.ndarray:
    """Lower-case letter of every code point below 2**16, a space for what is none."""
    out = np.full(1 << 16, 32, np.uint32)
    for c in map(chr, range(1 << 16)):
        if c.isalpha():
            low = c.lower()
            out[ord(c)] = ord(low if len(low) == 1 else c)
    return out


_LETTER = _letters()


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and how often each occurs. Code points above 2**16 count as letters."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    codes = np.where(codes < 1 << 16, _LETTER[np.minimum(codes, (1 << 16) - 1)], codes)
    space = codes == 32
    codes = np.concatenate([_SPACE, codes[~space | np.concatenate([[True], ~space[:-1]])], _SPACE])
    total = np.zeros(DIMENSION, np.int64)
    for a in range(0, len(codes), CHUNK):
        part = codes[a : a + CHUNK + ORDERS - 1]
        h, parts = part[:0], []
        for n in range(ORDERS):
            part_n = part[n : CHUNK + n]
            h = (part_n if n == 0 else h[: len(part_n)] ^ part_n) * _MIX[n]
            h = h ^ (h >> np.uint32(15))
            parts.append(h)
        h = np.concatenate(parts) * _MIX[0]
        total += np.bincount((h >> _SHIFT).view(np.int32), minlength=DIMENSION)
    features = np.flatnonzero(total)
    return features, total[features]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF features of unit length; counts are damped by a logarithm."""
    features, n = counts(text)
    values = (1 + np.log(n)) * idf[features]
    return features.astype(np.int32), (values / max(float(np.sqrt(values @ values)), 1e-12)).astype(np.float32)


def document_frequency(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Documents, and documents that have each feature; every task adds up its own before the exchange."""
    def task(batches):
        n, seen = 0, np.zeros(DIMENSION, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                seen[counts(text)[0]] += 1
        features = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"feature": np.append(features, -1), "n": np.append(seen[features], n)})

    got = docs.mapInArrow(task, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(DIMENSION + 1, np.int64)
    df[got["feature"].to_numpy()] = got["n"].to_numpy()
    return int(df[-1]), df[:-1]


class Rows:
    """Vectors and labels in a file of the folder, in the order they were added."""

    def __init__(self, folder: str):
        self.path, self.ends, self.labels = os.path.join(folder, "rows"), [0], []
        self.file = open(self.path, "wb")  # noqa: SIM115

    def add(self, features: np.ndarray, values: np.ndarray, label: int) -> None:
        self.file.write(features.tobytes() + values.tobytes())
        self.ends.append(self.ends[-1] + 2 * len(features))
        self.labels.append(label)

    def close(self) -> None:
        self.file.close()
        self.data = np.memmap(self.path, np.int32, "r") if self.ends[-1] else np.zeros(0, np.int32)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray, int]:
        part = np.array(self.data[self.ends[i] : self.ends[i + 1]])
        return part[: len(part) // 2], part[len(part) // 2 :].view(np.float32), self.labels[i]


def train(rows: Rows, kept: list[int], languages: int, folder: str):
    """FTRL-proximal weights of a softmax over the languages, as a function of features; ``DIMENSION`` is the bias."""
    z, n = (np.memmap(os.path.join(folder, name), np.float64, "w+", shape=(DIMENSION + 1, languages)) for name in "zn")

    def weights(at):
        zs, ns = np.array(z[at]), np.array(n[at])
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(kept)):
            features, values, label = rows[kept[i]]
            at, x = np.append(features, DIMENSION), np.append(values, 1.0)
            w = weights(at)
            p = np.exp((logits := x @ w) - logits.max())
            p /= p.sum()
            p[label] -= 1
            g = x[:, None] * p[None, :]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    return lambda at: weights(at).astype(np.float32)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """Scale that makes the held-back labels likeliest, by golden-section search on its logarithm."""
    step = max(1, (1 << 22) // logits.shape[1])

    def loss(t):
        total = 0.0
        for a in range(0, len(labels), step):
            s = np.asarray(logits[a : a + step]) / np.exp(t)
            s = s - s.max(axis=1, keepdims=True)
            total += float(np.sum(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), labels[a : a + step]]))
        return total

    a, b, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


@dataclass
class Model:
    """Its size follows the dimension and the number of languages, whatever it was learnt from."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    heat: float = 1.0

    def logits(self, text: str) -> np.ndarray:
        features, values = vector(text, self.idf)
        return values @ self.weights[features] + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        s = self.logits(text).astype(np.float64) / self.heat
        p = np.exp(s - s.max())
        k = int(p.argmax())  # the first of equals
        return self.languages[k], float(p[k] / p.sum())


#: Sizes of languages are sent to every task only up to so many languages.
SENT_LANGUAGES = 100_000


def sample(rows: DataFrame) -> DataFrame:
    """At most ``TRAIN_ROWS`` rows of each language, those with the smallest hashes.

    Equal rows have equal hashes; the rows of a language's smallest hash always stay, so copies of one row cannot take it out.
    """
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    rows = rows.withColumn("place", place)
    sizes = base.stage(rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("place").alias("least")), "sizes")
    share = F.least(F.lit(1.0), 2 * TRAIN_ROWS / F.col("n"))
    if sizes.count() <= SENT_LANGUAGES:  # else both sides meet in an exchange
        sizes = F.broadcast(sizes)
    near = rows.join(sizes, "lang").filter((F.col("place") < share * F.lit(1 << 40)) | (F.col("place") == F.col("least"))).drop("n", "least")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    return near.withColumn("k", first).filter(F.col("k") <= TRAIN_ROWS).drop("k")


def fit(rows: DataFrame) -> Model | None:
    """Model learnt from ``rows`` (doc_id, text, lang); rows without text, letters or language are passed over.

    None if nothing is left. The sample is trained in one task; it is bounded by ``TRAIN_ROWS`` per language.
    """
    spark = rows.sparkSession
    base.small_batches(spark)
    rows = rows.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & has_letter(F.col("text")))
    chosen = base.stage(sample(rows), "language")
    languages = sorted(r["lang"] for r in chosen.select("lang").distinct().collect())
    if not languages:
        return None
    total, df = document_frequency(rows.select("text"))
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    sent = spark.sparkContext.broadcast((languages, idf))

    def learn(batches):
        languages, idf = sent.value
        number = {lang: i for i, lang in enumerate(languages)}
        with tempfile.TemporaryDirectory() as folder:
            rows = Rows(folder)
            for batch in batches:
                for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                    rows.add(*vector(text, idf), number[lang])
            rows.close()
            size = len(rows.labels)
            held = [i for i in range(size) if i % 5 == 4]
            weights = train(rows, [i for i in range(size) if i % 5 != 4], len(languages), folder)
            heat = 1.0
            if held:
                bias = weights(np.array([DIMENSION]))[0]
                logits = np.memmap(os.path.join(folder, "held"), np.float32, "w+", shape=(len(held), len(languages)))
                for k, i in enumerate(held):
                    features, values, _ = rows[i]
                    logits[k] = values @ weights(features) + bias
                heat = temperature(logits, np.array([rows.labels[i] for i in held]))
            for a in range(0, DIMENSION + 1, BLOCK):
                part = weights(np.arange(a, min(a + BLOCK, DIMENSION + 1)))
                yield pa.RecordBatch.from_pydict({"first": [a], "weights": [part.tobytes()], "heat": [heat]})

    order = chosen.repartition(1).sortWithinPartitions("place", "doc_id").select("text", "lang")
    weights, heat = np.zeros((DIMENSION + 1, len(languages)), np.float32), 1.0
    for got in order.mapInArrow(learn, "first long, weights binary, heat double").toLocalIterator():
        part = np.frombuffer(got["weights"], np.float32).reshape(-1, len(languages))
        weights[got["first"] : got["first"] + len(part)], heat = part, got["heat"]
    return Model(languages, idf, weights[:-1], weights[-1], heat)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score for every row of ``docs``.

    Null and empty texts and texts without a letter are ``und`` with score 0, and so is everything without a model.
    Repeated rows get the same answer; equal probabilities go to the first language by name.
    """
    base.small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = list(keep)
    slim = docs.select(*names, F.when(has_letter(F.col("text")), F.col("text")).alias("letters"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema) + ", lang_pred string, score double"

    def answer(batch, model):
        got = [(UNKNOWN, 0.0) if t is None or model is None else model.predict(t) for t in batch.pop("letters")]
        return batch | {"lang_pred": [x for x, _ in got], "score": [x for _, x in got]}

    return base.map_batches(slim, answer, schema, start=lambda: sent.value)


def learnable() -> Column:
    """Rows the contract lets the model learn from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2


def kept_languages(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose language is known with a probability of ``least`` or more, columns as they are."""
    known = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns)}  # no column of the documents clashes with a result
    frame = docs.select("text", *(F.col(c).alias(n) for c, n in own.items()))
    return identify(frame, model, tuple(own.values())).filter(known).select(*(F.col(n).alias(c) for c, n in own.items()))
