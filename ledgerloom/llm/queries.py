"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import debruijn, decontaminate, exact_dedup, html_extract, mixing, quality, simhash, suffix_index, token_counts, tool_calls
from .common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_index.remove_repeats(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op4_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.remove_passages(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.chat_records(table(spark, sf_dir, "conversations"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max").drop("n_bytes")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_simhash": op3_simhash,
    "op4_debruijn_dedup": op4_debruijn_dedup,
    "op5_tool_calls": op5_tool_calls,
    "op6_main_text": op6_main_text,
    "op7_mix": op7_mix,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality": op9_quality,
    "op10_exact_dedup": op10_exact_dedup,
}

#: For DuckDB, with every table of the folder as a view.
ORACLE_SQL: dict[str, str] = {
    # bytes as pairs of hex digits
    "op1_suffix_dedup": r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), win AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d)
), rep AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS first FROM win) WHERE first < doc_id
), bytes AS (
  SELECT doc_id, unnest(range(0, length(h) // 2)) AS i, unnest(regexp_extract_all(h, '..')) AS x FROM d
), marked AS (
  SELECT bytes.doc_id, x, i, max(p) OVER (PARTITION BY bytes.doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM bytes LEFT JOIN rep ON rep.doc_id = bytes.doc_id AND p = i
), spans AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM marked
)
SELECT d.doc_id, count(x) AS n_bytes, count(x) FILTER (gone) AS n_removed, count(x) FILTER (starts) AS n_spans, sha256(unhex(coalesce(string_agg(x, '' ORDER BY i) FILTER (NOT gone), ''))) AS kept_sha256
FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id
""",
    "op4_debruijn_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, p, array_to_string(list_slice(w, p, p + 34), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d)
), rep AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY k) AS c FROM win) WHERE c > 1
), words AS (
  SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d
), marked AS (
  SELECT words.doc_id, x, i, max(p) OVER (PARTITION BY words.doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM words LEFT JOIN rep ON rep.doc_id = words.doc_id AND p = i
)
SELECT d.doc_id, count(x) AS n_words, count(x) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(x, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN marked USING (doc_id) GROUP BY d.doc_id
""",
    "op7_mix": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS most FROM s
), o AS (
  SELECT *, coalesce(sum(most) OVER before, 0) AS full_before, (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER before, 0) AS open_weight,
    1.5::DOUBLE * (SELECT sum(source_size) FROM w) AS total
  FROM w WINDOW before AS (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, (total - full_before) / open_weight AS level FROM o
), c AS (
  SELECT level FROM l WHERE level * weight <= most ORDER BY most / weight, source ASC NULLS LAST LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN (SELECT count(*) FROM c) = 0 THEN most ELSE least(most, (SELECT level FROM c) * weight) END AS target FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST(('0x' || substr(md5('mix-1' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS chance
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST((floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM r
""",
    "op10_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
""",
}
