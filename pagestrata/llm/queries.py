"""Registered queries of the operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.llm import (
    decontaminate, language, linerules, merkle, neighbours, packing, quality, resampling, secrets, sharding, simhash, substrings, token_counts,
)
from pagestrata.llm.base import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    answers = language.identify(docs, language.fit(docs.filter(language.learnable())))
    return answers.select("doc_id", F.coalesce(~language.learnable(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(quality.learnable())
    scores = quality.quality(table(spark, sf_dir, "documents"), labels)
    return scores.select("doc_id", F.coalesce(~quality.learnable(), F.lit(False)).alias("held_out"), "score", "predicted")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).drop("row_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, with_ids=False)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("row_id")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.top_k(table(spark, sf_dir, "embeddings"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.component_ids(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.shards(table(spark, sf_dir, "documents")))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linerules.quality_rules(table(spark, sf_dir, "documents")).drop("chars_removed")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(merkle.manifest(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_language_id, op3_quality, op4_secret_scan, op5_packing, op6_substring_dedup, op7_exact_top_k, op8_simhash,
        op9_decontamination, op10_sharding, op11_quality_rules, op12_resampling, op13_merkle_manifest,
    )
}

ORACLES: dict[str, str] = {}

ORACLES["op6_substring_dedup"] = r"""
WITH w AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), starts AS MATERIALIZED (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h
  FROM w, unnest(range(1, len(ws) - 33)) AS t(i) WHERE len(ws) >= 35
), again AS (SELECT h FROM starts GROUP BY h HAVING count(*) > 1),
gone AS (
  SELECT doc_id, list(DISTINCT k) AS ks FROM (
    SELECT s.doc_id, unnest(range(s.i, s.i + 35)) AS k FROM starts s JOIN again USING (h)
  ) GROUP BY doc_id
), kept AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(len(ks), 0) AS n_removed,
    list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda p: NOT list_contains(coalesce(ks, []), p[2])), lambda p: p[1]) AS rest
  FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(rest, ' ')) AS kept_sha256 FROM kept
"""

ORACLES["op7_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLES["op9_decontamination"] = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
), b AS MATERIALIZED (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark
), win AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS t
  FROM b, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS u(i) WHERE len(ws) > 0
), sizes AS (SELECT DISTINCT n FROM win),
starts AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS t FROM d, sizes, unnest(range(1, len(ws) - n + 2)) AS u(i) WHERE len(ws) >= n
), found AS MATERIALIZED (SELECT s.doc_id, s.i, s.n, win.item_id FROM starts s JOIN win ON win.n = s.n AND win.t = s.t),
hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM found GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""

ORACLES["op11_quality_rules"] = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, coalesce(text, '') AS body, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines FROM documents
), windows AS MATERIALIZED (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w FROM d, unnest(range(1, greatest(len(ws) - 2, 0) + 1)) AS t(i)
), again AS (SELECT doc_id, w FROM windows GROUP BY doc_id, w HAVING count(*) > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT windows.doc_id, unnest([i, i + 1, i + 2]) AS k FROM windows JOIN again USING (doc_id, w)) GROUP BY doc_id
), base AS MATERIALIZED (
  SELECT d.doc_id, len(ws) AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(full_lines) - len(list_distinct(full_lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN repeats ON repeats.doc_id = d.doc_id
), lines AS MATERIALIZED (
  SELECT doc_id, source, trim(regexp_replace(regexp_replace(lower(l), '[0-9]+', '0', 'g'), '[\x20\x09\x0B-\x0D]+', ' ', 'g')) AS line
  FROM d, unnest(full_lines) AS t(l)
), common AS (SELECT source, line FROM lines GROUP BY source, line HAVING count(DISTINCT doc_id) > 10),
sizes AS (
  SELECT lines.doc_id, sum(length(lines.line)) AS chars, sum(CASE WHEN common.line IS NOT NULL THEN length(lines.line) ELSE 0 END) AS lost
  FROM lines LEFT JOIN common ON common.line = lines.line AND common.source IS NOT DISTINCT FROM lines.source GROUP BY lines.doc_id
)
SELECT base.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * (coalesce(chars, 0) - coalesce(lost, 0)) >= coalesce(chars, 0) AS kept
FROM base LEFT JOIN sizes ON sizes.doc_id = base.doc_id
"""

# crc32 byte by byte over the distinct words, from a table made of eight shifts for each byte value
ORACLES["op12_resampling"] = r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS UBIGINT), [CAST(0 AS UBIGINT) for _ in range(8)]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END)) AS t
), d AS MATERIALIZED (
  SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
  UNION ALL
  SELECT 'b', CAST(item_id AS VARCHAR), list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark
), grams AS MATERIALIZED (SELECT kind, id, unnest(ws) AS w FROM d),
words AS MATERIALIZED (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM grams)),
crcs AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(range(length(x) // 2), lambda i: CAST(('0x' || x[2 * i + 1:2 * i + 2]) AS UBIGINT))),
    lambda c, b: xor(c >> 8, t[1 + CAST(xor(c, b) & 255 AS BIGINT)])), CAST(4294967295 AS UBIGINT)) % 10000 AS bucket FROM words, tab
), placed AS MATERIALIZED (SELECT kind, id, bucket FROM grams JOIN crcs USING (w)),
counts AS (SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM placed GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM counts),
gain AS MATERIALIZED (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(ss + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(tt + 10000 AS DOUBLE)))) AS BIGINT) AS g FROM counts, totals
), sums AS (SELECT id, count(*) AS n, sum(g) AS g FROM placed JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY id),
scored AS MATERIALIZED (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(CAST(floor(CAST(g AS DOUBLE) / n) AS BIGINT), 0) AS weight,
    CAST(floor(-1000 * ln(-ln((CAST(('0x' || sha256('2024:' || CAST(doc_id AS VARCHAR))[1:8]) AS BIGINT) + 0.5) / 4294967296::DOUBLE))) AS BIGINT) AS noise
  FROM documents LEFT JOIN sums ON sums.id = CAST(doc_id AS VARCHAR)
), places AS (
  SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT scored.doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(weight + noise AS BIGINT) AS score,
  CAST(CASE WHEN r <= 10 * n // 100 THEN r END AS BIGINT) AS rank
FROM scored LEFT JOIN places ON places.doc_id = scored.doc_id
"""

ORACLES["op13_merkle_manifest"] = r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS UBIGINT), [CAST(0 AS UBIGINT) for _ in range(8)]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END)) AS t
), d AS MATERIALIZED (
  SELECT doc_id, source, text, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head,
    xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))),
      lambda c, b: xor(c >> 8, t[1 + CAST(xor(c, b) & 255 AS BIGINT)])), CAST(4294967295 AS UBIGINT)) % 5 = 0 AS forge
  FROM documents, tab
), leaves AS MATERIALIZED (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n,
    sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN forge THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS forged
  FROM d
), low AS (
  SELECT source, 0 AS lvl, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT source, lvl + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY source, lvl, i // 16, n
), subs AS MATERIALIZED (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
  SELECT 0 AS lvl, i, n, subroot AS h FROM subs
  UNION ALL
  SELECT lvl + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY lvl, i // 16, n
), steps AS MATERIALIZED (
  SELECT l.doc_id, t.lvl AS step, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < l.i >> (4 * t.lvl)), '') AS a, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > l.i >> (4 * t.lvl)), '') AS b
  FROM leaves l JOIN low t ON t.source IS NOT DISTINCT FROM l.source AND t.n > 1 AND t.i >> 4 = l.i >> (4 * t.lvl + 4) GROUP BY l.doc_id, t.lvl, l.i
  UNION ALL
  SELECT l.doc_id, 1000 + t.lvl, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < s.i >> (4 * t.lvl)), ''), coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > s.i >> (4 * t.lvl)), '')
  FROM leaves l JOIN subs s ON s.source IS NOT DISTINCT FROM l.source JOIN high t ON t.n > 1 AND t.i >> 4 = s.i >> (4 * t.lvl + 4) GROUP BY l.doc_id, t.lvl, s.i
), paths AS (SELECT doc_id, string_agg(a || b, '' ORDER BY step) AS proof, list(struct_pack(a := a, b := b) ORDER BY step) AS sides FROM steps GROUP BY doc_id),
folds AS (
  SELECT l.doc_id, sides, coalesce(forged, leaf) AS h, 1 AS k FROM leaves l LEFT JOIN paths ON paths.doc_id = l.doc_id
  UNION ALL
  SELECT doc_id, sides, sha256(sides[k].a || h || sides[k].b), k + 1 FROM folds WHERE k <= coalesce(len(sides), 0)
)
SELECT l.doc_id, leaf, subroot, (SELECT h FROM high WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256, f.h AS folded_root,
  f.h = (SELECT h FROM high WHERE n = 1) AS verified
FROM leaves l JOIN subs s ON s.source IS NOT DISTINCT FROM l.source LEFT JOIN paths p ON p.doc_id = l.doc_id
JOIN folds f ON f.doc_id = l.doc_id AND f.k = coalesce(len(f.sides), 0) + 1
"""
