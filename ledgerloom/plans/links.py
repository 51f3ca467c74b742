"""Queries that link records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import norm_upper
from ..operators import linkage
from .registry import query, table


@query("""SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def missing_refs(spark, sf_dir):
    refs = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    blocks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return linkage.missing_refs(refs, blocks, "o_orderkey", F.col("o_orderpriority") == "5-LOW").select("o_orderkey")


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'HIGH' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MID' ELSE o_orderpriority END AS priority FROM orders""")
def alias_canonicalisation(spark, sf_dir):
    aliases = spark.createDataFrame([("1-URGENT", "HIGH"), ("2-HIGH", "HIGH"), ("3-MEDIUM", "MID")], "alias string, canonical string")
    rows = table(spark, sf_dir, "orders")
    return rows.join(F.broadcast(aliases), rows["o_orderpriority"] == aliases["alias"], "left").select("o_orderkey", F.coalesce("canonical", F.upper("o_orderpriority")).alias("priority"))  # three fixed rows


def refs_and_blocks(spark, sf_dir):
    """Parts as blocks, and references to them whose code is right, cut short, or another one."""
    k = F.col("p_partkey")
    code = F.lpad((k * 37 % 99991 + 100000).cast("string"), 8, "7")
    base = table(spark, sf_dir, "part").select(
        k.alias("block_id"), code.alias("code"), F.when(k % 3 == 0, "PRÓPRIO").otherwise("SINAPI").alias("bank"), F.concat(F.lit("1."), k.cast("string")).alias("item"),
        F.concat_ws(" ", F.lit("FORNECIMENTO DE"), F.upper("p_name"), F.col("p_type"), F.concat(F.lit("MODELO"), (k % 977).cast("string")), F.lit("INSTALADO")).alias("descricao"), F.col("p_brand").alias("unit"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("quant"),
    )
    n = F.col("block_id")
    refs = base.withColumn("ref_id", n).withColumn("code", F.when(n % 4 == 0, F.expr("substring(code, 1, 7)")).when(n % 4 == 1, F.concat(F.lit("000"), n.cast("string"))).otherwise(F.col("code")))
    refs = refs.withColumn("item", F.when(n % 8 == 1, "").otherwise(F.col("item"))).withColumn("descricao", F.when(n % 8 == 1, "OUTRO TEXTO SEM PARENTESCO").otherwise(F.col("descricao"))).withColumn("price", F.when(n % 8 == 1, 1.0).otherwise(F.col("price")))
    return refs.drop("block_id"), base


@query("""SELECT p_partkey AS ref_id, CASE WHEN p_partkey % 8 = 1 THEN NULL ELSE p_partkey END AS block_id, CASE WHEN p_partkey % 8 = 1 THEN CASE WHEN p_partkey % 3 = 0 THEN 'nao_associada' ELSE 'item_direto' END WHEN p_partkey % 4 IN (0, 1) THEN 'associada_por_indicio' ELSE 'associada_diretamente' END AS status FROM part""")
def ref_resolution(spark, sf_dir):
    refs, blocks = refs_and_blocks(spark, sf_dir)
    return linkage.resolve(refs, blocks).select("ref_id", "block_id", "status")


@query("""SELECT substr(code, 1, 7) AS alias, bank, code AS canonical FROM (SELECT lpad(CAST(p_partkey * 37 % 99991 + 100000 AS VARCHAR), 8, '7') AS code, CASE WHEN p_partkey % 3 = 0 THEN 'PRÓPRIO' ELSE 'SINAPI' END AS bank, p_partkey FROM part) WHERE p_partkey % 4 = 0""")
def truncation_alias(spark, sf_dir):
    refs, blocks = refs_and_blocks(spark, sf_dir)
    sig = lambda df, seen: df.select("code", "bank", F.col("descricao").alias("sig"), "unit", "price", F.lit(seen).alias("referenced"), "item")
    return linkage.canonical_codes(sig(blocks, True).union(sig(refs.where("length(code) = 7 and code not like '000%'"), False)))


@query("""SELECT p_partkey AS ref_id, CASE WHEN p_partkey % 4 = 1 THEN NULL ELSE p_partkey END AS block_id, CASE p_partkey % 4 WHEN 0 THEN 'alias' WHEN 1 THEN 'none' ELSE 'code' END AS how FROM part""")
def alias_lookup(spark, sf_dir):
    refs, blocks = refs_and_blocks(spark, sf_dir)
    n = F.col("block_id")
    aliases = blocks.where(n % 4 == 0).select(F.expr("substring(code, 1, 7)").alias("alias"), "bank", F.col("code").alias("canonical"))
    return linkage.lookup_with_alias(refs.withColumn("u", F.concat(F.lit("no"), F.col("ref_id").cast("string"))).select("ref_id", "code", "bank", "item", "u"), blocks.withColumn("u", n.cast("string")), aliases, ["u"], ("item",))


@query("""SELECT p_partkey AS key, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' COM INSTALACAO' ELSE '' END AS budget_descricao, CASE WHEN p_partkey % 3 = 0 THEN 'UN' ELSE 'M' END AS budget_und, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' COM INSTALACAO' ELSE '' END AS composition_descricao, 'UN' AS composition_und FROM part""")
def cross_table_fill(spark, sf_dir):
    k = F.col("p_partkey")
    full = F.concat("p_name", F.when(k % 2 == 0, " COM INSTALACAO").otherwise(""))
    p = table(spark, sf_dir, "part")
    budget = p.select(k.alias("key"), F.when(k % 4 == 0, F.col("p_name")).otherwise(full).alias("descricao"), F.when(k % 6 == 0, "").when(k % 3 == 0, "CM").otherwise("M").alias("und"))
    comp = p.select(k.alias("key"), F.when(k % 4 == 2, F.col("p_name")).otherwise(full).alias("descricao"), F.lit("UN").alias("und"))
    return linkage.enrich(budget, comp, "key")


@query("""SELECT p_partkey AS line_id, CASE WHEN p_partkey % 10 = 0 THEN 'no_code_bank_match' WHEN p_partkey % 3 = 1 THEN 'same_code_but_no_occurrence_context_match' ELSE 'matched_by_occurrence_context' END AS reason FROM part""")
def diff_scan(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    text = norm_upper(F.col("p_name"))
    known = p.where("p_partkey % 10 <> 0").select(k.cast("string").alias("code"), F.lit("SINAPI").alias("bank"), F.lit(1).alias("page"), k.cast("string").alias("tail"), text.alias("sig"), F.concat(F.lit("p/"), k.cast("string")).alias("path"))
    seen = p.select(k.alias("line_id"), k.cast("string").alias("code"), F.lit("SINAPI").alias("bank"), F.when(k % 3 == 1, 2).otherwise(1).alias("page"), F.when(k % 3 == 1, "x").otherwise(k.cast("string")).alias("tail"), text.alias("sig"))
    return linkage.occurrence_match(seen, known).select("line_id", "reason")


@query("""WITH i AS (SELECT user_id, event_id AS iid, event_id AS s, event_id + 40 AS e FROM events WHERE event_type = 'signup'), p AS (SELECT user_id, event_id AS pid FROM events WHERE event_type = 'purchase'), d AS (SELECT pid, iid, greatest(s - pid, pid - e, 0) AS distance FROM p JOIN i USING (user_id))
SELECT pid, iid, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY distance, iid) AS rank FROM d) WHERE rank <= 5""")
def nearest_interval_top5(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    points = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("pid"), F.col("event_id").alias("at"))
    spans = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("iid"), F.col("event_id").alias("s"), (F.col("event_id") + 40).alias("e"))
    return linkage.nearest_intervals(points, spans, ["user_id"], "at", "s", "e", "iid", "pid")


@query("""SELECT l_orderkey, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_partkey % 5 = 0) GROUP BY 1""")
def text_containment(spark, sf_dir):
    line_id = F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", line_id.alias("line_id"), F.concat(F.lit("Insumo P"), F.col("l_partkey").cast("string"), F.lit(" SINAPI qualquer")).alias("text")).distinct()
    ids = table(spark, sf_dir, "part").where("p_partkey % 5 = 0").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("code"), F.lit("SINAPI").alias("bank"))
    hits = linkage.contained_identities(lines, ids, "line_id", "text")
    return hits.groupBy(F.split("line_id", "-")[0].cast("long").alias("l_orderkey")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'b' || p_partkey AS source, 'c' || p_partkey AS target, 'budget_to_main_composition' AS relation FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'x' || p_partkey, 'g' || p_partkey, 'global_to_contextual_auxiliary' FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'b' || p_partkey, 'g' || p_partkey, 'same_key_cluster' FROM part WHERE p_partkey % 3 = 0""")
def entity_edges(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    side = lambda df, letter: df.select(k.alias("key"), F.concat(F.lit(letter), k.cast("string")).alias("id"))
    return linkage.edges(side(p, "b"), side(p.where(k % 2 == 0), "c"), side(p, "x"), side(p.where(k % 3 == 0), "g"), "key").select("source", "target", "relation")


@query("""SELECT o_orderkey AS item, count(l.l_orderkey) AS n, CASE WHEN count(l.l_orderkey) = 0 THEN 'missing_composition' ELSE 'linked' END AS state FROM orders LEFT JOIN lineitem l ON l_orderkey = o_orderkey GROUP BY 1""")
def chain_join(spark, sf_dir):
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    budget = o.select(F.col("o_orderkey").alias("item"), F.col("o_orderkey").alias("key"))
    principals = line.select(F.col("l_orderkey").alias("key"), F.col("l_orderkey").alias("block")).distinct()
    rows = line.select(F.col("l_orderkey").alias("block"), F.col("l_partkey").cast("string").alias("key"))
    globals_ = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_partkey").alias("block"))
    out = linkage.chains(budget, principals, rows, globals_)
    return out.groupBy("item").agg(F.count("row_key").alias("n"), F.max(F.when(F.col("state") == "missing_composition", "missing_composition").otherwise("linked")).alias("state"))


@query("""WITH x AS (SELECT l.l_orderkey, l.l_partkey, l.l_linenumber, l.l_extendedprice, (p_brand = 'Brand#' || l_linenumber)::INT AS a, (p_size = CAST(l_quantity AS INT))::INT AS b, p_name AS tipo FROM lineitem l JOIN part p ON p_partkey // 3 = l_partkey // 3)
SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, tipo FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_linenumber, l_extendedprice ORDER BY a DESC, b DESC, length(tipo) DESC, tipo DESC) AS rn FROM x) WHERE rn = 1""")
def deferred_enrichment(spark, sf_dir):
    """Lines look among the parts of their lot of three."""
    lot = lambda c: F.floor(F.col(c) / 3).alias("code")
    keys = ["l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice"]
    pending = table(spark, sf_dir, "lineitem").select(F.struct(*keys).alias("row_id"), lot("l_partkey"), F.concat(F.lit("Brand#"), F.col("l_linenumber").cast("string")).alias("bank"), F.col("l_quantity").cast("int").alias("unit")).distinct()
    known = table(spark, sf_dir, "part").select(lot("p_partkey"), F.col("p_brand").alias("bank"), F.col("p_size").alias("unit"), F.col("p_name").alias("tipo"))
    return linkage.progressive_match(pending, known, "row_id", "code", ["bank", "unit"], "tipo").select("row_id.*", "tipo")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def patch_merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    k = F.col("o_orderkey")
    patches = o.where(k % 3 == 1).select("o_orderkey", F.when(k % 6 == 1, "X").otherwise("").alias("value"), F.lit(0.9).alias("confidence")).union(o.where(k % 6 == 1).select("o_orderkey", F.lit("Y"), F.lit(0.5)))
    new, _ = linkage.merge_patches(o, patches, "o_orderkey", "o_orderstatus", F.col("value") != "")
    return new


@query("""SELECT CASE WHEN o_orderkey % 6 = 1 THEN 'applied' ELSE 'invalid_value' END AS outcome, count(*) AS n FROM orders WHERE o_orderkey % 3 = 1 GROUP BY 1 UNION ALL SELECT 'low_confidence', count(*) FROM orders WHERE o_orderkey % 6 = 1""")
def patch_log(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    k = F.col("o_orderkey")
    patches = o.where(k % 3 == 1).select("o_orderkey", F.when(k % 6 == 1, "X").otherwise("").alias("value"), F.lit(0.9).alias("confidence")).union(o.where(k % 6 == 1).select("o_orderkey", F.lit("Y"), F.lit(0.5)))
    _, log = linkage.merge_patches(o, patches, "o_orderkey", "o_orderstatus", F.col("value") != "")
    return log.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT DISTINCT l_orderkey AS key FROM lineitem WHERE l_orderkey % 4 = 0""")
def materialise_orphans(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")).distinct()
    return linkage.materialise(line, line.where("key % 4 <> 0"), line, "key")
