"""Queries on what tables lack and on section headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import schema
from .registry import query, table

_EXPECTED = ["codigo", "banco", "descricao", "und", "quant", "total"]
_LIST = "['codigo', 'banco', 'descricao', 'und', 'quant', 'total']"


def _tables(spark, sf_dir):
    """Each part as a table that lacks one column, or one in seven of them two."""
    k = F.col("p_partkey")
    names = F.array(*map(F.lit, _EXPECTED))
    has = F.filter(names, lambda c: ~((F.array_position(names, c) - 1 == k % 6) | ((k % 7 == 0) & (F.array_position(names, c) - 1 == k % 5))))
    return table(spark, sf_dir, "part").select(k.alias("table_id"), has.alias("available"), names.alias("expected"), "p_size", "p_type")


_GAPS = f"""t AS (SELECT p_partkey AS table_id, p_size, {_LIST} AS e, list_filter({_LIST}, lambda c: NOT (list_position({_LIST}, c) - 1 = p_partkey % 6 OR (p_partkey % 7 = 0 AND list_position({_LIST}, c) - 1 = p_partkey % 5))) AS a FROM part),
  g AS (SELECT table_id, p_size, a, unnest(e) AS missing, unnest(range(1, 7)) AS place FROM t),
  m AS (SELECT *, list_filter(list_slice({_LIST}, 1, place - 1), lambda c: list_contains(a, c))[-1] AS lft, list_filter(list_slice({_LIST}, place + 1, 6), lambda c: list_contains(a, c))[1] AS rgt FROM g WHERE NOT list_contains(a, missing))"""


@query(f"""WITH {_GAPS}, s AS (SELECT table_id, missing, p_size, unnest([rgt, lft]) AS source, unnest([0, 1]) AS side FROM m),
  v AS (SELECT *, p_size % 2 = 0 AS sampled, CASE WHEN p_size % 2 = 1 THEN 0 WHEN source = 'banco' AND missing = 'banco' THEN 0 WHEN source = 'banco' THEN CASE missing WHEN 'codigo' THEN 1 WHEN 'descricao' THEN 2 WHEN 'und' THEN 1 WHEN 'quant' THEN 1 WHEN 'total' THEN 1 ELSE 0 END ELSE 0 END AS n FROM s WHERE source IS NOT NULL),
  b AS (SELECT *, row_number() OVER (PARTITION BY table_id, missing ORDER BY side) AS rn FROM v WHERE NOT sampled OR n > 0)
  SELECT table_id, missing, source, CASE WHEN sampled THEN 'words' ELSE 'place' END AS method, CASE WHEN sampled THEN 0.86 ELSE 0.68 END AS confidence, n AS sample_rows FROM b WHERE rn = 1""")
def missing_column_plan(spark, sf_dir):
    t = _tables(spark, sf_dir)
    samples = t.where("p_size % 2 = 0").select("table_id", F.lit("banco").alias("column"), F.explode(F.array(F.concat(F.col("table_id") + 1000), F.lit("KG"))).alias("text"))
    return schema.merge_plan(t, samples)


@query(f"""WITH {_GAPS} SELECT table_id, missing, lft AS "left", rgt AS "right", CASE WHEN missing = 'codigo' AND rgt = 'banco' AND table_id % 4 = 0 THEN 'fused_header_detected' ELSE 'missing_expected_column' END AS code,
  CASE WHEN missing IN ('codigo', 'banco', 'descricao') THEN 'high' ELSE 'medium' END AS severity, CASE WHEN missing = 'codigo' AND rgt = 'banco' AND table_id % 4 = 0 THEN 'banco' END AS fused_with FROM m""")
def schema_anomalies(spark, sf_dir):
    t = _tables(spark, sf_dir)
    header = F.when((F.col("canonical") == "banco") & (F.col("table_id") % 4 == 0), "Código Banco").when(F.col("canonical") == "codigo", "Código").otherwise(F.initcap("canonical"))
    columns = t.select("table_id", F.posexplode("available").alias("index", "canonical")).withColumn("header", header)
    expected = t.select("table_id", F.posexplode("expected").alias("index", "canonical")).withColumn("header", F.when(F.col("canonical") == "codigo", "Código").otherwise(F.initcap("canonical")))
    return schema.anomalies(columns, expected)


@query("""WITH l AS (SELECT l_orderkey AS doc, l_linenumber AS line_no, l_partkey % 9 AS k, l_quantity FROM lineitem), s AS (SELECT *, CASE WHEN k < 6 THEN chr(CAST(65 + k AS INT)) WHEN k = 6 THEN 'B' WHEN k = 7 THEN 'E' END AS section FROM l),
  f AS (SELECT *, row_number() OVER (PARTITION BY doc, section ORDER BY line_no, k) AS rn FROM s WHERE section IS NOT NULL)
  SELECT doc, section, line_no AS page, CASE WHEN k < 6 THEN section || ' - linha' WHEN k = 6 THEN 'Mão de Obra' ELSE 'Tempos fixos' END AS header, CASE section WHEN 'A' THEN 10 WHEN 'B' THEN 7 WHEN 'C' THEN 8 WHEN 'D' THEN 8 WHEN 'E' THEN 9 ELSE 10 END AS n_columns FROM f WHERE rn = 1""")
def section_headers(spark, sf_dir):
    k = F.col("l_partkey") % 9
    text = F.when(k < 6, F.concat(F.chr((k + 65).cast("long")), F.lit(" - linha"))).when(k == 6, "Mão  de Obra").when(k == 7, "Tempos fixos").otherwise("Custo horário")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), k.alias("line_no"), text.alias("text"), *[F.lit(0.0).alias(c) for c in ("x0", "x1", "y0", "y1")])
    return schema.section_map(lines).select("doc", "section", "page", "header", F.size("columns").alias("n_columns"))
