"""Secrets in texts: long mixed tokens and values of secret names, judged by a random forest that removes false positives.

Everything runs as DataFrame and SQL expressions and Spark's own forest; no Python runs on the executors. Candidates are
runs of ``LEAST`` or more token characters that hold a digit or change from lower to upper case, tokens in a published key
format, and whatever is assigned to a secret name, of any length and any characters but white space. The forest sees their
length, character mix and transitions, how much of them the corpus's own words cover, the path (column ``source``) and
the words around them.

The forest learns from labelled findings. Where none are given, they are made by rules from the candidates themselves:
published key formats and assignments to a name such as "password" are secrets, long numbers too; other numbers, UUIDs, tokens covered by
dictionary words, placeholders and tokens next to words such as "checksum" are not; the rest is unlabelled.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.llm import base

LEAST = 16
#: Digits from which a bare number assigned to a secret name is a key; a shorter one is a setting, unless the name is a password's.
KEY_DIGITS = 12
#: Share of distinct texts, two at least, that makes a word part of the dictionary.
WORD_SHARE, WORD_TEXTS = 0.001, 2
#: Labelled findings learnt from at most; trees and their depth.
TRAIN_ROWS, TREES, DEPTH, SEED = 20_000, 40, 8, 17
REDACTED = "[SECRET]"
_TOKEN = rf"[A-Za-z0-9+/_\-]{{{LEAST},}}={{0,2}}"

# Public key formats and words that stand beside secrets or beside harmless tokens.
KEY_FORMATS = (
    r"^AKIA[0-9A-Z]{16}$", r"^ASIA[0-9A-Z]{16}$", r"^gh[pousr]_[A-Za-z0-9]{36,}$", r"^xox[abprs]-[A-Za-z0-9-]{10,}$",
    r"^AIza[A-Za-z0-9_-]{35}$", r"^sk-[A-Za-z0-9_-]{20,}$", r"^[sr]k_live_[A-Za-z0-9]{16,}$", r"^eyJ[A-Za-z0-9_-]{20,}$",
)
SECRET_NAMES = r"(?i)(passw|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer|auth)"
HARMLESS_NAMES = r"(?i)(commit|revision|checksum|sha-?\d*|md5|uuid|guid|example|sample|dummy|phone|tel|card|isbn|etag|digest)\W*$"
PLAIN_PATHS = r"(?i)(test|example|sample|fixture|mock|doc)"
PLACEHOLDER = r"(?i)^([*x._\-#]+|null|none|nil|true|false|undefined|\$?\{.*|<.*|%.*%|\$[A-Z_]+)$"

_FORMAT = "(?<![A-Za-z0-9])(?:" + "|".join(p.removeprefix("^").removesuffix("$") for p in KEY_FORMATS) + ")(?![A-Za-z0-9])"
# The names of SECRET_NAMES, but not secretary, tokenizer and author.
_NAME = r"(?:passw|pwd|secret(?!ar)|token(?!i[sz])|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer|auth(?!or(?!i[sz])))"
_TO = rf"{_NAME}[\w.\-]*[\"'`\])\\]*\s*(?::=|=>|==|=|:)\s*(?:[\"'`]?(?:bearer|basic|token)\s+)?"
#: Every value that reaches to the end of the text; a name inside a value may have one of its own.
_ASSIGNED = rf"(?i)(?={_TO}(\S+)$)"
# What candidates() takes, in a whole text.
_MIXED = rf"(?=[A-Za-z0-9+/_\-]*(?:[0-9]|[a-z][A-Z])){_TOKEN}"

FEATURES = (
    "length", "digits", "uppers", "lowers", "marks", "distinct", "hex", "transitions", "letter_digit", "digit_letter", "vowels",
    "coverage", "path_plain", "path_bucket", "assigned", "quoted", "secret_name", "secret_before", "harmless_before", "before_length",
    "after_length",
)


def _value(rest: Column) -> Column:
    """An assigned value without its quotes, or without the punctuation that ends its sentence or list."""
    quoted = F.regexp_extract(rest, r"^\\?([\"'`])(.*?)(?:\\?\1|$)", 2)
    closed = F.regexp_replace(rest, r"[\"'`.,;]+$", "")
    bare = F.when(closed.rlike(r"[(\[{<]"), closed).otherwise(F.regexp_replace(rest, r"[\"'`.,;)\]}>]+$", ""))
    return F.when(rest.rlike(r"^\\?[\"'`]"), quoted).otherwise(bare)


def candidates(docs: DataFrame) -> DataFrame:
    """(row_id, doc_id, path, word_no, part_no, candidate, by_name, lead, before, after) of every candidate token.

    ``by_name`` tells that it is assigned to a secret name. ``lead`` is what stands before it in its own word, ``before`` and
    ``after`` are the neighbouring words.
    """
    words = F.split("text", r"\s+")
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.col("source").alias("path"), "text")
    rows = rows.withColumn("named", F.col("text").rlike(rf"(?i){_TO}\S"))
    rows = rows.filter(F.col("named") | F.col("text").rlike(_TOKEN.removesuffix("={0,2}").replace(",}", "}")) | F.col("text").rlike(_FORMAT)).select("row_id", "doc_id", "path", "named", words.alias("words"))
    at = lambda i: F.coalesce(F.get("words", i), F.lit(""))
    near = lambda i: F.concat_ws(" ", at(i - 3), at(i - 2), at(i - 1), at(i))
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).rlike(_TOKEN) | F.get("words", i).rlike(_FORMAT) | (F.col("named") & near(i).rlike(_ASSIGNED)))
    found = F.transform(places, lambda i: F.struct(i.alias("word_no"), F.get("words", i).alias("word"), near(i).alias("near"), F.concat(at(i - 2), F.lit(" "), at(i - 1)).alias("before"), at(i + 1).alias("after")))
    rows = rows.select("row_id", "doc_id", "path", F.explode(found).alias("f")).select("row_id", "doc_id", "path", "f.*")
    values = F.filter(F.transform(F.regexp_extract_all("near", F.lit(_ASSIGNED), F.lit(1)), _value), lambda v: v.rlike(r"[^=:<>\"'`,;.()\[\]{}\\]") & ~v.rlike("(?i)^(bearer|basic)$"))
    rows = rows.withColumns({"tokens": F.regexp_extract_all("word", F.lit(_TOKEN), F.lit(0)), "formats": F.regexp_extract_all("word", F.lit(_FORMAT), F.lit(0)), "values": values})
    others = F.array_except(F.array_union("formats", "values"), "tokens")
    rows = rows.select("*", F.posexplode(F.concat("tokens", others)).alias("part_no", "candidate"))
    rows = rows.withColumns({"by_name": F.array_contains("values", F.col("candidate")), "lead": F.expr("substring(word, 1, instr(word, candidate) - 1)")})
    mixed = F.col("candidate").rlike(r"[0-9]|[a-z][A-Z]")
    return rows.filter(mixed | F.col("by_name") | F.array_contains("formats", F.col("candidate"))).drop("word", "near", "tokens", "formats", "values")


def dictionary(docs: DataFrame) -> DataFrame:
    """Lower-case ASCII words of three letters or more that ``WORD_SHARE`` of the distinct texts use outside candidates."""
    texts = docs.filter(F.col("text").isNotNull())
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", rf"(?i)({_TO})\S+", "$1 "), _FORMAT, " "), _MIXED, " ")
    words = F.array_distinct(F.filter(F.split(F.lower(rest), "[^a-z]+"), lambda w: F.length(w) >= 3))
    texts = texts.select(F.sha2("text", 256).alias("key"), words.alias("words")).groupBy("key").agg(F.first("words").alias("words"))
    counts = base.stage(texts.select(F.explode(F.array_append("words", F.lit(""))).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "words")
    total = counts.filter("word = ''").first()  # the empty word is in every text
    least = max(WORD_TEXTS, math.ceil(WORD_SHARE * total["n"])) if total else WORD_TEXTS
    return counts.filter((F.col("word") != "") & (F.col("n") >= least)).select("word")


def featured(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with the columns of ``FEATURES``; ``words`` is the dictionary."""
    key = ["row_id", "word_no", "part_no"]
    pieces = found.select(*key, F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    known = pieces.select("word").distinct().join(words, "word")
    covered = pieces.join(known, "word").groupBy(*key).agg(F.sum(F.length("word")).alias("covered"))
    c, n = F.col("candidate"), F.length("candidate")
    kind = lambda pattern, text=c: F.regexp_count(text, F.lit(pattern)).cast("double")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    flag = lambda column: F.coalesce(column, F.lit(False)).cast("double")
    features = {
        "length": n.cast("double"), "digits": kind("[0-9]") / n, "uppers": kind("[A-Z]") / n, "lowers": kind("[a-z]") / n, "marks": kind("[^A-Za-z0-9]") / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n, "hex": flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "transitions": kind("a(?=[^a])|A(?=[^A])|0(?=[^0])|[^aA0](?=[aA0])", classes) / n, "letter_digit": kind("[A-Za-z](?=[0-9])") / n,
        "digit_letter": kind("[0-9](?=[A-Za-z])") / n, "vowels": kind("(?i)[aeiou]") / n, "coverage": F.coalesce(F.col("covered"), F.lit(0)) / n,
        "path_plain": flag(F.col("path").rlike(PLAIN_PATHS)), "path_bucket": F.pmod(F.xxhash64("path"), F.lit(16)).cast("double"),
        "assigned": flag(F.concat("before", "lead").rlike("[=:]\\W*$")), "quoted": flag(F.col("lead").rlike("[\"']$")),
        "secret_name": flag(F.col("lead").rlike(SECRET_NAMES)), "secret_before": flag(F.col("before").rlike(SECRET_NAMES)),
        "harmless_before": flag(F.concat("before", F.lit(" "), "lead").rlike(HARMLESS_NAMES)), "before_length": F.length("before").cast("double"),
        "after_length": F.length("after").cast("double"),
    }
    return found.join(covered, key, "left").select("*", *(v.cast("double").alias(k) for k, v in features.items())).drop("covered")


def rule_label() -> Column:
    """1 or 0 by the rules above, null for the rest."""
    c = F.col("candidate")
    format_ = F.lit(False)
    for pattern in KEY_FORMATS:
        format_ = format_ | c.rlike(pattern)
    by_name, password = F.col("by_name"), F.concat_ws(" ", "before", "lead").rlike("(?i)passw|pwd")
    strong = by_name & ((F.col("quoted") == 1) | F.concat("before", "lead").rlike(r"=\W*$"))
    harmless = (
        ((F.col("digits") == 1) & ~(by_name & (password | (F.length(c) >= KEY_DIGITS)))) | ((F.col("coverage") >= 0.6) & ~strong) | (F.col("distinct") * F.col("length") <= F.when(by_name, 1).otherwise(4))
        | (F.col("harmless_before") == 1) | c.rlike(r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$") | (by_name & c.rlike(PLACEHOLDER))
    )
    open_ = by_name & ((F.col("coverage") >= 0.6) | (c.rlike(r"^\p{L}+$") & ~strong))  # a word of a sentence, or of code
    named = by_name | ((F.col("assigned") == 1) & ((F.col("secret_name") == 1) | (F.col("secret_before") == 1)))
    return F.when(format_, 1.0).when(harmless, 0.0).when(open_, F.lit(None)).when(named, 1.0)


def train(labelled: DataFrame):
    """Forest from ``FEATURES`` and ``label`` (1 secret, 0 false positive); None unless both labels occur.

    About ``TRAIN_ROWS / 2`` findings of each label are learnt from at most, those with the smallest hashes and one in any case;
    both labels weigh the same.
    """
    place = F.pmod(F.xxhash64("candidate", "row_id", "word_no", "part_no", F.monotonically_increasing_id()), F.lit(1 << 30)) / float(1 << 30)
    labelled = labelled.select("label", *FEATURES, place.alias("place")).filter(F.col("label").isin(0.0, 1.0))
    sizes = {r["label"]: r for r in labelled.groupBy("label").agg(F.count("*").alias("n"), F.min("place").alias("least")).collect()}
    if len(sizes) < 2:
        return None
    share = {label: max(r["least"], min(1.0, TRAIN_ROWS / 2 / r["n"])) for label, r in sizes.items()}
    of = lambda v: F.when(F.col("label") == 1.0, v[1.0]).otherwise(v[0.0])
    rows = labelled.filter(F.col("place") <= of(share))
    vectors = base.stage(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("label", "features"), "findings")
    taken = {r["label"]: r["n"] for r in vectors.groupBy("label").agg(F.count("*").alias("n")).collect()}
    weights = {label: sum(taken.values()) / 2 / n for label, n in taken.items()}
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt", subsamplingRate=0.8, weightCol="weight")
    return forest.fit(vectors.withColumn("weight", of(weights)))


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(row_id, doc_id, path, word_no, part_no, candidate, score, is_secret) of every candidate in every whole text.

    ``labelled`` are findings with ``FEATURES`` and ``label``; without them the rules label the candidates. Where no forest
    can be learnt (one label only), labels decide, and what has none scores 0.5 and stays a finding. Null and empty texts have no
    candidates; a null ``source`` is a path like any other; repeated rows are findings each. No rows give no rows.
    """
    found = base.stage(candidates(docs), "candidates")
    rows = base.stage(featured(found, dictionary(docs)).withColumn("label", rule_label()), "features")
    forest = train(rows if labelled is None else labelled)
    if forest is None:
        scored = rows.withColumn("score", F.coalesce("label", F.lit(0.5)))
    else:
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
        scored = forest.transform(vectors).withColumn("score", vector_to_array("probability")[1])
    return scored.select("row_id", "doc_id", "path", "word_no", "part_no", "candidate", "score", (F.col("score") >= 0.5).alias("is_secret"))


def redacted(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """``docs`` with every secret of ``scan(docs)`` replaced wherever it stands in its text, columns as they are.

    Secrets shorter than ``LEAST`` are replaced where no letter or digit touches them, so that words stay whole.
    """
    secrets = findings.filter("is_secret").groupBy("row_id").agg(F.array_sort(F.collect_set(F.struct((-F.length("candidate")).alias("n"), "candidate"))).alias("secrets"))
    def without(text, s):
        exact = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.replace(s["candidate"], F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\p{L}\p{N}])"))
        return F.when(F.length(s["candidate"]) < LEAST, F.regexp_replace(text, exact, F.lit(REDACTED))).otherwise(F.replace(text, s["candidate"], F.lit(REDACTED)))

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.struct(*docs.columns).alias("row")).join(secrets, "row_id", "left")
    clean = F.when(F.col("secrets").isNull(), F.col("row.text")).otherwise(F.aggregate("secrets", F.col("row.text"), without))
    return rows.select(*(clean.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
