"""Queries that find, clean and judge text, and the whole run."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import format_ptbr
from ..operators import recovery
from . import lifecycle
from .numbers import PT
from .registry import query, table

_KEYS = ["l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice"]


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN user_id % 2 = 0 WHEN 1 THEN value > 0 WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true ELSE false END AS ok,
  CASE WHEN event_id % 6 = 0 AND user_id % 2 <> 0 THEN 'unknown_unit' WHEN event_id % 6 = 3 THEN 'money_parse_failed' WHEN event_id % 6 = 5 THEN 'pollution_term:LS =>' ELSE '' END AS reason FROM events""")
def field_validation(spark, sf_dir):
    k = F.col("event_id") % 6
    pick = lambda *x: F.element_at(F.array(*x), (k + 1).cast("int"))
    field = pick(*map(F.lit, ["und", "quant", "total", "valor_unit", "codigo", "descricao"]))
    value = pick(F.when(F.col("user_id") % 2 == 0, "kg").otherwise("zz"), F.concat(format_ptbr(F.col("value"))), format_ptbr(F.col("value")), F.lit("12/3"), F.col("event_type"), F.lit("TUBO LS => 4"))
    return table(spark, sf_dir, "events").withColumn("v", recovery.validate(field, value)).select("event_id", "v.ok", "v.reason")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey + 10000 AS VARCHAR) || '/001' ELSE '' END AS codigo, CASE WHEN p_partkey % 2 = 0 THEN 'SINAPI' ELSE '' END AS banco, p_name || ' ' || p_type AS descricao FROM part""")
def split_code_prefix(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.concat_ws(" ", F.when(k % 2 == 0, F.concat((k + 10000).cast("string"), F.lit("/001 SINAPI"))), "p_name", "p_type")
    return table(spark, sf_dir, "part").withColumn("r", recovery.split_prefix(text)).select("p_partkey", "r.codigo", "r.banco", "r.descricao")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS hits, CASE p_partkey % 3 WHEN 0 THEN -2.5 WHEN 1 THEN 0.25 ELSE 1.55 END AS delta, p_partkey % 3 = 2 AS safe FROM part""")
def ownership_score(spark, sf_dir):
    k = F.col("p_partkey")
    target = F.concat_ws(" ", F.lit("SERVICO DE"), F.upper("p_name"), F.concat(F.lit("N"), k.cast("string")))
    near = F.array(F.concat_ws(" ", F.lit("OUTRA LINHA"), F.concat(F.lit("V"), k.cast("string"))))
    text = F.when(k % 3 == 0, F.concat_ws(" ", target, near[0])).when(k % 3 == 1, F.concat(F.lit("- "), target)).otherwise(target)
    rows = table(spark, sf_dir, "part").withColumn("o", recovery.ownership(text, F.when(k % 3 == 2, target).otherwise(""), target, near))
    return rows.select("p_partkey", F.col("o.hits").alias("hits"), F.col("o.delta").alias("delta"), F.col("o.safe").alias("safe"))


@query("""SELECT p_partkey AS row_id, p_partkey + 1 AS owner_id FROM part WHERE p_partkey % 2 = 0""")
def foreign_fragments(spark, sf_dir):
    """Every other part's text ends in a fragment that the next part owns."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    mine = lambda n: F.concat(F.lit("DONO DO "), n.cast("string"), F.lit(" FIM"))
    rows = p.select(k.alias("row_id"), F.concat_ws(" ", F.lit("TEXTO"), F.when(k % 2 == 0, mine(k + 1)).otherwise(mine(k))).alias("text"))
    fragments = p.select((k + 1).alias("owner_id"), mine(k + 1).alias("fragment"), F.lit(0.95).alias("confidence"))
    return recovery.foreign_fragments(rows, fragments).select("row_id", "owner_id")


@query("""WITH c AS (SELECT p_partkey AS key, p_partkey % 3 <> 0 AS d, p_partkey % 4 <> 0 AS u, p_partkey % 5 <> 0 AS p, p_partkey % 7 = 0 AS a FROM part)
SELECT key, 'descricao' AS field, CASE WHEN d THEN 'confirmed' ELSE 'warning' END AS severity FROM c UNION ALL SELECT key, 'und', CASE WHEN u THEN 'confirmed' ELSE 'strong' END FROM c UNION ALL SELECT key, 'unit_price', CASE WHEN p THEN 'confirmed' ELSE 'warning' END FROM c UNION ALL SELECT key, 'auxiliary_chain', 'info' FROM c WHERE a""")
def chain_conflicts(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        k.alias("key"), F.col("p_name").alias("b_descricao"), F.when(k % 3 == 0, "outro texto").otherwise(F.concat("p_name", F.lit(" completo"))).alias("c_descricao"), F.lit("un").alias("b_und"), F.when(k % 4 == 0, "m").otherwise("UN").alias("c_und"),
        F.col("p_retailprice").alias("b_price"), (F.col("p_retailprice") * F.when(k % 5 == 0, 1.5).otherwise(1.05)).alias("c_price"), F.when(k % 7 == 0, 2).otherwise(0).alias("missing_auxiliaries"),
    )
    return recovery.chain_conflicts(rows)


@query("""SELECT l_orderkey AS page, CAST(l_partkey + 10000 AS VARCHAR) AS code, CASE WHEN l_linenumber % 2 = 0 THEN 'code_bank' ELSE 'code_only' END AS match, CASE WHEN l_linenumber % 2 = 0 THEN 0.96 ELSE 0.65 END AS confidence, count(*) AS n FROM lineitem GROUP BY ALL""")
def code_occurrences(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    code = (F.col("l_partkey") + 10000).cast("string")
    pages = line.select(F.col("l_orderkey").alias("page"), F.concat_ws(" ", F.lit("ver"), code, F.when(F.col("l_linenumber") % 2 == 0, "SINAPI"), F.lit("tubo")).alias("text"))
    ids = table(spark, sf_dir, "part").select((F.col("p_partkey") + 10000).cast("string").alias("code"), F.lit("SINAPI").alias("bank"))
    return recovery.occurrences(pages, ids).groupBy("page", "code", "match", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, CASE WHEN l_linenumber % 3 = 0 THEN '1' ELSE {PT.format(x="l_quantity")} END AS quant FROM lineitem WHERE l_quantity <> 1 OR l_linenumber % 3 <> 0
UNION ALL SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, {PT.format(x="l_quantity")} FROM lineitem WHERE l_quantity = 1 AND l_linenumber % 3 = 0""")
def printed_tokens(spark, sf_dir):
    """Quantities that are missing or equal take the printed token; others stay."""
    m = F.col("l_linenumber") % 3
    window = F.concat_ws(" ", F.lit("TUBO UN"), format_ptbr(F.col("l_quantity")), F.lit("2,00"), format_ptbr(F.col("l_extendedprice")))
    current = F.when(m == 0, "1").when(m == 1, "").otherwise(F.col("l_quantity").cast("long").cast("string"))
    return table(spark, sf_dir, "lineitem").select(*_KEYS, recovery.printed_token(window, current, "quant").alias("quant"))


@query("""WITH l AS (SELECT o_custkey AS doc, o_orderkey AS ord, CASE o_orderkey % 5 WHEN 0 THEN 'p' WHEN 1 THEN 'h' ELSE 'r' END AS t FROM orders), s AS (SELECT *, last_value(CASE t WHEN 'p' THEN '' WHEN 'h' THEN substr('ABCDEF', CAST(ord % 6 AS INT) + 1, 1) END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY ord ROWS UNBOUNDED PRECEDING) AS section, last_value(CASE t WHEN 'p' THEN lpad(CAST(ord AS VARCHAR), 7, '1') END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY ord ROWS UNBOUNDED PRECEDING) AS composition FROM l)
SELECT doc, ord, section, composition, CASE t WHEN 'p' THEN 'principal' WHEN 'h' THEN 'header' ELSE 'row' END AS kind FROM s""")
def section_state(spark, sf_dir):
    k = F.col("o_orderkey")
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("Composição "), F.lpad(k.cast("string"), 7, "1"), F.lit(" SICRO3 x"))).when(k % 5 == 1, F.concat(F.element_at(F.array(*map(F.lit, "ABCDEF")), (k % 6 + 1).cast("int")), F.lit(" - Secao"))).otherwise("Insumo SICRO3 M0030")
    )
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), k.alias("ord"), text.alias("t"))
    return recovery.section_state(rows, "doc", "ord", "t").select("doc", "ord", "section", "composition", "kind")


@query("""SELECT p_partkey AS row_id, p_size * 1.0::DOUBLE AS q, p_retailprice AS price, round(p_size * p_retailprice, 4) AS cost, true AS closes FROM part""")
def closing_combination(spark, sf_dir):
    k = F.col("p_partkey").alias("row_id")
    p = table(spark, sf_dir, "part")
    add = lambda field, value, score: p.select(k, F.lit(field).alias("field"), value.cast("double").alias("value"), F.lit(score).alias("score"))
    q, u = F.col("p_size"), F.col("p_retailprice")
    rows = add("q", q, 0.5).union(add("q", q + 7, 0.6)).union(add("price", u, 0.5)).union(add("cost", F.round(q * u, 4), 0.5)).union(add("cost", u + 3, 0.6))
    return recovery.close_section_rows(rows).select("row_id", "q", "price", "cost", "closes")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'sem_referencia_no_sintetico' WHEN 1 THEN 'divergente' ELSE 'ok' END AS status FROM part""")
def reference_compare(spark, sf_dir):
    k, u = F.col("p_partkey") % 4, F.col("p_retailprice")
    ref = F.when(k == 1, u + 1).when(k != 0, u)
    part = F.when(k != 0, u * 2.2)
    return table(spark, sf_dir, "part").select("p_partkey", recovery.compare_reference(u, ref, F.lit(2.0), u * 1.1, part).alias("status"))


@query("""WITH p AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), h AS (SELECT *, max((event_type IN ('click', 'error'))::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS near FROM p)
SELECT event_id, CASE WHEN event_type = 'error' THEN 'sicro' WHEN event_type = 'click' THEN 'table' WHEN near AND event_type = 'view' THEN 'text' WHEN near THEN 'context' ELSE 'skip' END AS plan FROM h""")
def page_plan(spark, sf_dir):
    t = F.col("event_type")
    text = F.when(t == "error", "Composição SICRO3").when(t == "click", "Código Banco Quant.").when(t == "view", "1,00 2,00 3,00").otherwise("capa")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", text.alias("text"))
    return recovery.page_plan(rows, ["user_id"], "event_id", "text").select("event_id", "plan")


@query("""WITH a AS (SELECT l_orderkey AS k, count(*) AS n, sum(CAST(round(l_extendedprice, 2) AS DECIMAL(18,2))) AS s FROM lineitem GROUP BY 1)
SELECT k, n, CASE WHEN k % 4 = 0 THEN 'component_sum_lower_than_principal' WHEN k % 4 = 1 THEN 'component_sum_greater_than_principal' ELSE 'ok' END AS status FROM a""")
def whole_run(spark, sf_dir):
    """Every order printed as a page of a composition, and read back by all stages."""
    line = table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    price = format_ptbr(F.col("l_extendedprice"))
    row = F.concat(F.lit("Insumo "), F.lpad(F.col("l_partkey").cast("string"), 8, "0"), F.lit(" SINAPI ITEM DA OBRA UN 1,0000000 "), price, F.lit(" "), price)
    pages = line.groupBy(k.alias("k")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("s"), F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("rows"))
    total = format_ptbr(F.col("s") + F.when(F.col("k") % 4 == 0, F.col("s") + 50).when(F.col("k") % 4 == 1, -F.col("s") / 2).otherwise(0.0))
    head = F.concat(F.lit("Composição "), F.lpad(F.col("k").cast("string"), 7, "9"), F.lit(" SINAPI OBRA COMPLETA UN 1,0000000 "), total, F.lit(" "), total)
    pages = pages.select(F.col("k").cast("string").alias("doc_id"), F.lit(1).alias("page"), F.concat(head, F.lit("\n"), F.col("rows")).alias("text"))
    out = lifecycle.run(lifecycle.STAGES, {"pages": pages})
    if not out.ok:
        raise RuntimeError(out.issues)
    return out.relations["math"].select(F.split("k", "#")[0].cast("long").alias("k"), F.col("n_rows").alias("n"), "status")
