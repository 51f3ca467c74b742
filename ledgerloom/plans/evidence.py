"""Queries on evidence for values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import norm_upper
from ..operators import choice, evidence, structure
from .registry import query, table

#: Evidence for the unit and the price of parts, from the lines that name them.
_EVIDENCE = """SELECT CAST(l_partkey AS VARCHAR) AS key, CASE WHEN l_linenumber % 2 = 0 THEN 'und' ELSE 'valor_unit' END AS field, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE CAST(CAST(l_quantity AS BIGINT) % 5 AS VARCHAR) END AS value, l_linestatus AS source, 0.6 + l_discount * 3 AS confidence, CAST(l_suppkey % 3 AS INT) AS page FROM lineitem"""


def seen(spark, sf_dir):
    even = F.col("l_linenumber") % 2 == 0
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("key"), F.when(even, "und").otherwise("valor_unit").alias("field"), F.when(even, F.col("l_returnflag")).otherwise((F.col("l_quantity").cast("long") % 5).cast("string")).alias("value"),
        F.col("l_linestatus").alias("source"), (F.lit(0.6) + F.col("l_discount") * 3).alias("confidence"), (F.col("l_suppkey") % 3).cast("int").alias("page"),
    )


@query(f"SELECT key, field, value, count(*) AS n, count(DISTINCT source) AS sources, round(max(confidence), 6) AS max_confidence FROM ({_EVIDENCE}) GROUP BY 1, 2, 3")
def evidence_index(spark, sf_dir):
    return evidence.index(seen(spark, sf_dir)).withColumn("max_confidence", F.round("max_confidence", 6))


@query(f"""WITH g AS (SELECT key, field, value, count(*) AS n, count(DISTINCT page) AS pages, avg(CAST(confidence AS DECIMAL(18,6)))::DOUBLE AS mean FROM ({_EVIDENCE}) GROUP BY 1, 2, 3)
SELECT key AS row_id, field, value, n, pages, least(0.99, mean + CASE WHEN n >= 2 OR pages >= 2 THEN 0.04 ELSE 0 END) >= 0.8201 AND (n >= 2 OR pages >= 2 OR mean >= 0.94) AS accepted FROM g""")
def occurrence_consensus(spark, sf_dir):
    rows = seen(spark, sf_dir).withColumnRenamed("key", "row_id").withColumn("confidence", F.col("confidence").cast("decimal(18,6)"))
    return evidence.occurrence_consensus(rows, min_confidence=0.8201).select("row_id", "field", "value", "n", "pages", "accepted")


@query(f"""WITH i AS (SELECT key, field, value, count(*) AS n, count(DISTINCT source) AS sources, max(confidence) AS mc FROM ({_EVIDENCE}) GROUP BY 1, 2, 3), s AS (SELECT *, round(mc + least(0.08, 0.02 * n) + least(0.06, 0.03 * sources), 4) AS score FROM i)
SELECT key AS row_id, field, value, score FROM (SELECT *, row_number() OVER (PARTITION BY key, field ORDER BY score DESC, value DESC) AS rn FROM s WHERE score >= 0.82) WHERE rn = 1""")
def field_consensus(spark, sf_dir):
    i = evidence.index(seen(spark, sf_dir)).withColumnRenamed("key", "row_id").withColumn("expected", F.lit(None).cast("string"))
    return evidence.best_candidate(i)


@query(f"""WITH e AS ({_EVIDENCE}), l AS (SELECT DISTINCT key, field, value FROM e WHERE page = 0 AND source = 'F') SELECT e.key, e.field, e.value, e.source, round(least(0.995, e.confidence + CASE WHEN l.key IS NOT NULL THEN 0.06 ELSE 0.03 END), 4) AS confidence, l.key IS NOT NULL AS locked FROM e LEFT JOIN l ON e.key = l.key AND e.field = l.field AND e.value = l.value""")
def ownership_boost(spark, sf_dir):
    e = seen(spark, sf_dir)
    return evidence.ownership_boost(e, e.where("page = 0 and source = 'F'")).select("key", "field", "value", "source", "confidence", "locked")


@query(f"""WITH g AS (SELECT key, field, lower(value) AS norm, max(confidence) AS c, count(*) AS n, count(DISTINCT source) AS s, min(value) AS value FROM ({_EVIDENCE}) WHERE confidence >= 0.65 GROUP BY 1, 2, 3), x AS (SELECT *, round(c + 0.18 * (n - 1) + CASE WHEN s >= 2 THEN 0.22 ELSE 0 END, 6) AS score FROM g)
SELECT key, field, value, round(score, 4) AS score, n FROM (SELECT *, row_number() OVER (PARTITION BY key, field ORDER BY score DESC, value DESC) AS rn FROM x) WHERE rn = 1""")
def ledger_best(spark, sf_dir):
    return evidence.ledger_best(seen(spark, sf_dir), F.lower("value"), 0.65).withColumn("score", F.round("score", 4))


_PRODUCERS = ["same_block_band", "same_budget_row", "declared_table", "other_physical", "calculated"]
_RANKS = "CASE event_id % 5 WHEN 0 THEN 100 WHEN 1 THEN 95 WHEN 2 THEN 90 WHEN 3 THEN 50 ELSE 10 END"


def entries(spark, sf_dir):
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("path"), F.col("value").cast("string").alias("value"), F.element_at(F.array(*map(F.lit, _PRODUCERS)), (k % 5 + 1).cast("int")).alias("producer"), k.alias("ord"))


@query(f"""SELECT path, producer, rank, rank >= 90 AS can_overwrite FROM (SELECT user_id || '/' || event_type AS path, list_value('same_block_band', 'same_budget_row', 'declared_table', 'other_physical', 'calculated')[event_id % 5 + 1] AS producer, {_RANKS} AS rank, row_number() OVER (PARTITION BY user_id, event_type ORDER BY {_RANKS} DESC, event_id) AS rn FROM events) WHERE rn = 1""")
def authority_argmax(spark, sf_dir):
    return evidence.strongest(entries(spark, sf_dir)).drop("value")


@query("""SELECT CASE event_id % 5 WHEN 3 THEN 'supporting' WHEN 4 THEN 'calculated_audit_only' ELSE 'pdf_declared' END AS truth, count(*) AS n FROM events GROUP BY 1""")
def truth_counts(spark, sf_dir):
    return entries(spark, sf_dir).groupBy(evidence.truth_type(F.col("producer")).alias("truth")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type AS path, 'f' AS field, CAST(user_id % 3 AS VARCHAR) AS value, p AS producer, 'ok' AS status, min(event_id) AS ord FROM (SELECT *, unnest(['a', 'b']) AS p FROM events) WHERE p = 'a' OR event_id % 2 = 0 GROUP BY ALL""")
def evidence_registry(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("path"), F.lit("f").alias("field"), (F.col("user_id") % 3).cast("string").alias("value"), F.lit("ok").alias("status"), F.col("event_id").alias("ord"))
    return evidence.registry(e.withColumn("producer", F.lit("a")), e.where("ord % 2 = 0").withColumn("producer", F.lit("b"))).select("path", "field", "value", "producer", "status", "ord")


@query("""WITH v AS (SELECT l_returnflag || l_linestatus AS canonical, l_linenumber AS col_index, sum(greatest(CAST(round_even(l_discount * 10, 0) AS BIGINT), 1))::BIGINT AS votes, max(l_discount) AS best, avg(CAST(l_discount AS DECIMAL(10,4)))::DOUBLE AS mean FROM lineitem GROUP BY 1, 2)
SELECT canonical, col_index, votes, round(0.65 * best + 0.35 * mean, 4) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY votes DESC, col_index) AS rn FROM v) WHERE rn = 1""")
def column_vote(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("canonical"), F.col("l_linenumber").alias("col_index"), F.col("l_discount").alias("confidence"))
    return evidence.column_vote(rows).withColumn("confidence", F.round("confidence", 4))


_UNITS = "list_value('UN', 'CM', 'M2', 'CX')[CAST(l_linenumber % 4 AS INT) + 1]"


@query(f"""WITH s AS (SELECT l_partkey AS key, {_UNITS} AS u, sum(CAST(l_discount + CASE WHEN l_tax > 0.04 THEN 1.2 ELSE 0 END + CASE WHEN {_UNITS} = 'UN' THEN 0.3 ELSE 0 END + CASE WHEN {_UNITS} IN ('UN', 'M2') THEN 0.35 ELSE 0 END - CASE WHEN {_UNITS} = 'CM' AND l_partkey % 2 = 0 THEN 6 ELSE 0 END AS DECIMAL(18,4)))::DOUBLE AS total FROM lineitem GROUP BY 1, 2),
t AS (SELECT key, arg_max(u, (total, u)) AS u, max(total) AS total FROM s GROUP BY 1), o AS (SELECT key, arg_max(u, (total, u)) AS u, max(total) AS total FROM s WHERE u <> 'CM' GROUP BY 1)
SELECT t.key, CASE WHEN t.u = 'CM' AND t.key % 2 = 0 AND o.total >= t.total - 0.5 THEN o.u ELSE t.u END AS unit, round(CASE WHEN t.u = 'CM' AND t.key % 2 = 0 AND o.total >= t.total - 0.5 THEN o.total ELSE t.total END, 4) AS score FROM t LEFT JOIN o USING (key)""")
def unit_arbitration(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("key"), F.element_at(F.array(*map(F.lit, ["UN", "CM", "M2", "CX"])), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("unit"), F.col("l_discount").alias("source_score"),
        (F.col("l_tax") > 0.04).alias("mapped"), F.lit("UN").alias("current_unit"), (F.col("l_partkey") % 2 == 0).alias("dimension_context"),
    )
    return evidence.arbitrate_unit(rows).withColumn("score", F.round("score", 4))


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'unresolved' WHEN s = 0 AND m THEN 'physical_pdf_evidence_math_confirmed' WHEN s = 0 THEN 'physical_pdf_evidence' WHEN s = 1 AND m THEN 'extracted_cross_evidence_math_confirmed' WHEN s = 1 THEN 'extracted_cross_evidence' WHEN s = 2 THEN 'math_only_expected' WHEN m THEN 'math_confirmed_existing_value' ELSE 'weak_candidate' END AS grade,
  event_id % 7 <> 0 AND (s < 2 OR (s = 3 AND m)) AS supported FROM (SELECT event_id, event_id % 4 AS s, event_id % 3 = 0 AS m FROM events)""")
def evidence_grade(spark, sf_dir):
    k = F.col("event_id")
    source = F.element_at(F.array(*map(F.lit, ["Deep_Area_Sweep", "budget.item", "math_expected", "somewhere"])), (k % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").withColumn("grade", evidence.grade(F.when(k % 7 == 0, "").otherwise("1"), source, k % 3 == 0))
    return rows.select("event_id", "grade", evidence.is_supported(F.col("grade")).alias("supported"))


@query("""SELECT event_id, event_id % 4 IN (0, 1) AND event_id % 3 <> 1 OR event_id % 4 = 2 AND event_id % 3 = 0 AS allowed FROM events""")
def relation_contract(spark, sf_dir):
    k = F.col("event_id")
    relation = F.element_at(F.array(*map(F.lit, ["budget_to_main_composition", "global_to_contextual_auxiliary", "same_key_cluster", "unknown"])), (k % 4 + 1).cast("int"))
    field = F.element_at(F.array(*map(F.lit, ["und", "quant", "valor_unit"])), (k % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", evidence.relation_allows(relation, field).alias("allowed"))


@query("""WITH c AS (SELECT user_id, event_id, round(value, 4) AS score FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id::VARCHAR) AS rn, lead(score) OVER (PARTITION BY user_id ORDER BY score DESC, event_id::VARCHAR) AS second FROM c WHERE event_id % 10 <> 0), k AS (SELECT DISTINCT user_id FROM c)
SELECT k.user_id, CASE WHEN r.user_id IS NULL THEN 'no_safe_candidate' WHEN score - 20 < CASE WHEN k.user_id % 2 = 0 THEN 1.15 ELSE 2.2 END THEN 'ambiguous_margin' WHEN score - second < 0.45 THEN 'ambiguous_competing_candidates' ELSE 'replace' END AS decision FROM k LEFT JOIN r ON k.user_id = r.user_id AND rn = 1""")
def choose_or_abstain(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "user_id", F.col("event_id").cast("string").alias("value"), F.round("value", 4).alias("score"), F.lit("current").alias("current"), F.lit(20.0).alias("current_score"), (F.col("user_id") % 2 == 0).alias("current_weak"), (F.col("event_id") % 10 != 0).alias("safe")
    )
    return evidence.choose_or_abstain(rows, ["user_id"]).select("user_id", "decision")


@query()
def evidence_graph(spark, sf_dir):
    """Greedy clusters depend on the order; tests hold this against a plain loop."""
    text = F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string"))
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), F.col("p_partkey").alias("ord"), norm_upper(text).alias("upper"))
    return evidence.description_clusters(rows)


@query()
def description_registry(spark, sf_dir):
    """An ordered fold; tests hold this against a plain loop."""
    text = F.concat_ws(" ", F.lit("FORNECIMENTO E INSTALACAO DE"), "p_name", "p_type", F.col("p_size").cast("string"))
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), F.col("p_partkey").alias("ord"), text.alias("descricao"), norm_upper(text).alias("upper"), F.lit(1.0).alias("weight"))
    return evidence.description_registry(rows)


_HEADS = ["Código", "Banco", "Descrição", "Tipo", "Und", "Quant.", "Valor Unit (R$)", "Valor Total"]


@query("""SELECT n_nationkey AS table_id, h.canonical, CAST((h.i - n_nationkey % 3 + 8) % 8 AS INT) AS col_index FROM nation, (VALUES ('codigo', 0), ('banco', 1), ('descricao', 2), ('und', 4), ('quant', 5), ('valor_unit', 6), ('total', 7)) h(canonical, i)""")
def header_map(spark, sf_dir):
    """Eight headers, turned round by up to two places."""
    cells = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("table_id"), F.posexplode(F.array(*map(F.lit, _HEADS))).alias("i", "text"))
    return structure.header_map(cells.withColumn("col_index", ((F.col("i") - F.col("table_id") % 3 + 8) % 8).cast("int"))).select("table_id", "canonical", "col_index")


_COLS = "SELECT p_brand AS table_id, p_partkey AS id, p_partkey * 1.5::DOUBLE AS x0, p_partkey * 1.5::DOUBLE + p_size / 10.0 AS x1 FROM part"


def columns(spark, sf_dir):
    x0 = F.col("p_partkey") * 1.5
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("table_id"), F.col("p_partkey").alias("id"), x0.alias("x0"), (x0 + F.col("p_size") / 10.0).alias("x1"))


@query(f"SELECT table_id, id, x0, coalesce(lead(x0) OVER (PARTITION BY table_id ORDER BY x0), 1e9) AS bound FROM ({_COLS})")
def band_bounds(spark, sf_dir):
    return structure.band_bounds(columns(spark, sf_dir), "table_id").drop("x1")


@query(f"""SELECT table_id, id, round(least(coalesce((lag(x1) OVER w + x0) / 2, x0), x0), 4) AS "left", round(greatest(coalesce((x1 + lead(x0) OVER w) / 2, x1), x1), 4) AS "right" FROM ({_COLS}) WINDOW w AS (PARTITION BY table_id ORDER BY x0, x1)""")
def midpoint_bands(spark, sf_dir):
    return structure.midpoint_bands(columns(spark, sf_dir), "table_id").select("table_id", "id", F.round("left", 4).alias("left"), F.round("right", 4).alias("right"))


@query("""SELECT CAST(p_partkey % 5 AS INT) AS table_id, p_partkey AS id, CASE WHEN p_size < 10 THEN 'a' WHEN p_size < 20 THEN 'b' WHEN p_size < 30 THEN 'c' WHEN p_size < 40 THEN 'd' WHEN p_size < 50 THEN 'e' ELSE 'f' END AS canonical FROM part""")
def band_assignment(spark, sf_dir):
    words = table(spark, sf_dir, "part").select((F.col("p_partkey") % 5).cast("int").alias("table_id"), F.col("p_partkey").alias("id"), (F.col("p_size") * 10.0).alias("x0"), (F.col("p_size") * 10.0 + 1).alias("x1"))
    bands = spark.createDataFrame([(t, c, i * 100.0, i * 100.0 + 99) for t in range(5) for i, c in enumerate("abcdef")], "table_id int, canonical string, x0 double, x1 double")
    return structure.assign_bands(words, bands, "table_id", "id")


@query("""WITH r AS (SELECT p_brand, p_type, p_size::DOUBLE AS x0, unnest(range(0, greatest(1, least(4, p_size % 6)))) AS k FROM part) SELECT p_brand, p_type, median(x0) AS x0, median(x0 + 5) AS x1, count(*) AS n FROM r GROUP BY 1, 2""")
def median_bands(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", "p_type", F.col("p_size").cast("double").alias("x0"), (F.col("p_size") + 5.0).alias("x1"), (F.col("p_size") % 6).alias("weight"))
    return structure.learned_bands(rows, ["p_brand", "p_type"])


@query("""WITH a AS (SELECT p_brand, median(p_size::DOUBLE) AS m FROM part WHERE p_partkey % 3 = 0 GROUP BY 1), b AS (SELECT p_brand, median(p_size::DOUBLE) AS m FROM part WHERE p_partkey % 3 = 1 AND p_brand <> 'Brand#7' GROUP BY 1)
SELECT coalesce(a.p_brand, b.p_brand) AS p_brand, coalesce((a.m + b.m) / 2, a.m, b.m) AS x0, coalesce(abs(a.m - b.m) > 2, false) AS adjusted, CASE WHEN a.m IS NULL OR b.m IS NULL THEN 0 WHEN abs(a.m - b.m) > 2 THEN 0.04 ELSE 0.08 END AS gain FROM a FULL JOIN b USING (p_brand)""")
def band_blend(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    bands = lambda df: df.groupBy("p_brand").agg(F.median("p_size").alias("x0")).withColumn("x1", F.col("x0") + 5)
    return structure.blend_bands(bands(p.where("p_partkey % 3 = 0")), bands(p.where("p_partkey % 3 = 1 and p_brand <> 'Brand#7'")), ["p_brand"]).drop("x1")


@query("""SELECT p_brand AS table_id, c AS col_index, CASE c WHEN 0 THEN 'codigo' WHEN 1 THEN 'banco' WHEN 2 THEN 'und' WHEN 3 THEN 'numero' WHEN 4 THEN 'descricao' ELSE 'unknown' END AS role FROM (SELECT DISTINCT p_brand FROM part), range(0, 7) t(c)""")
def column_roles(spark, sf_dir):
    k = F.col("p_partkey")
    cells = [
        (k + 10000).cast("string"), F.when(k % 2 == 0, "SINAPI").otherwise("SICRO3"), F.when(k % 2 == 0, "m2").otherwise("UN"), F.concat(k.cast("string"), F.lit(",50")),
        F.concat(F.lit("servico de "), F.col("p_name"), F.lit(" completo")), F.lit("x y"), F.when(k % 2 == 0, "kg").otherwise("?"),
    ]
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("table_id"), F.posexplode(F.array(*cells)).alias("col_index", "text"))
    return structure.column_roles(rows).select("table_id", F.col("col_index").cast("long").alias("col_index"), "role")


@query("""WITH s AS (SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, CASE WHEN l_linenumber = 1 THEN 'P0' WHEN l_linenumber = 2 OR l_partkey % 5 = 0 THEN 'P1' WHEN l_partkey % 7 = 0 THEN 'P2' ELSE 'P3' END AS bucket FROM lineitem)
SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, bucket, place FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY l_orderkey, l_partkey, l_linenumber, l_extendedprice) AS place FROM s) WHERE place <= 400""")
def priority_schedule(spark, sf_dir):
    c = F.col
    bucket = choice.priority((c("l_linenumber") == 1).cast("int"), (c("l_linenumber") == 2).cast("int"), c("l_partkey") % 5 == 0, c("l_partkey") % 7 == 0)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", bucket.alias("bucket"))
    return choice.top_of_each(rows, ["bucket"], ["l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice"], 400)


@query("""WITH v AS (SELECT l_orderkey AS block, l_returnflag AS variant, count(*) AS n_rows, abs(sum(CAST(l_quantity AS BIGINT)) - 50)::DOUBLE AS distance, count(*) FILTER (l_tax = 0) AS missing, count(DISTINCT l_linenumber) AS n_pages FROM lineitem GROUP BY 1, 2)
SELECT block, variant, n_rows, distance, missing FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY distance, missing, n_rows DESC, n_pages DESC, variant) AS rn FROM v) WHERE rn = 1""")
def least_bad_variant(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("block"), F.col("l_returnflag").alias("variant"))
    rows = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.abs(F.sum(F.col("l_quantity").cast("long")) - 50).cast("double").alias("distance"), F.count_if(F.col("l_tax") == 0).alias("missing"), F.count_distinct("l_linenumber").alias("n_pages"))
    return choice.least_bad(rows, ["block"])


@query("""WITH v AS (SELECT o_custkey AS doc, o_orderstatus AS engine, count(*) AS n, sum(o_orderkey % 3)::BIGINT AS issues FROM orders GROUP BY 1, 2), s AS (SELECT doc, engine, 200 * 1 + 8 * n + 12 * 2 + 50 * 1.0 - 300 * issues AS score FROM v WHERE engine <> 'P')
SELECT doc, engine, score::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, engine DESC) AS rn FROM s) WHERE rn = 1""")
def best_of_engines(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc"), F.col("o_orderstatus").alias("engine")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("o_orderkey") % 3).alias("issues"))
    zero = {c: F.lit(0) for c in ("contract", "no_evidence", "math_failures")}
    rows = rows.withColumns({"compositions": F.lit(1), "sections": F.lit(2), "confidence": F.lit(1.0), **zero, "profile": F.when(F.col("engine") == "P", "diagnostic").otherwise("production")})
    return choice.engine_score(rows, ["doc"])


@query("""WITH m AS (SELECT user_id, event_id, value, value < 5 AS low, event_type = 'error' AS wrong FROM events) SELECT user_id, max(value) FILTER (NOT low AND NOT wrong) AS score, count(*) FILTER (low) AS n_low, count(*) FILTER (wrong) AS n_wrong FROM m GROUP BY 1""")
def template_choice(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type")
    out = choice.best_with_reasons(rows, ["user_id"], F.col("value"), {"low": F.col("value") < 5, "wrong": F.col("event_type") == "error"}, ["event_id"])
    return out.select("user_id", "score", "n_low", "n_wrong")


@query("""SELECT n_nationkey AS table_id, n_nationkey % 2 = 0 AS is_header FROM nation""")
def header_rows(spark, sf_dir):
    """Every other table has a header; the others name two columns only."""
    k = F.col("n_nationkey")
    heads = F.when(k % 2 == 0, F.array(*map(F.lit, _HEADS))).otherwise(F.array(F.lit("Código"), F.lit("Und"), F.lit("x")))
    cells = table(spark, sf_dir, "nation").select(k.alias("table_id"), F.posexplode(heads).alias("col_index", "text"))
    return structure.is_header(structure.header_map(cells), "table_id", ["codigo", "banco", "descricao"])
