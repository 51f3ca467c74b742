"""Queries that hold declared totals against their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import DECIMAL
from ..operators import reconcile, repair
from .registry import query, table

#: What a line adds to its order, and what the order declares: the true sum, off for some orders.
AMOUNT = "round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 2)"
_SUMS = f"SELECT l_orderkey AS k, round(sum({AMOUNT}), 4) AS s, count(*) AS n FROM lineitem GROUP BY 1"
_DECLARED = "CASE WHEN s IS NULL THEN 100.0 WHEN k % 10 = 0 THEN round(s * 1.01, 2) + 1 WHEN k % 10 = 1 THEN s - 5 WHEN k % 10 = 2 THEN s + 0.03 WHEN k % 10 = 3 AND s > 1000 THEN s + 0.5 WHEN k % 10 = 4 THEN NULL ELSE s END"


def components(spark, sf_dir):
    c = F.col
    amount = F.round(c("l_extendedprice") * (1 - c("l_discount")) * (1 + c("l_tax")), 2)
    return table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("k"), "l_partkey", "l_linenumber", amount.alias("amount"))


def declared(spark, sf_dir):
    """Every order with the total that a document would print."""
    s, k = F.col("s"), F.col("k")
    sums = components(spark, sf_dir).groupBy("k").agg(F.round(F.sum("amount"), 4).alias("s"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority").join(sums, "k", "left")
    value = (
        F.when(s.isNull(), 100.0).when(k % 10 == 0, F.round(s * 1.01, 2) + 1).when(k % 10 == 1, s - 5).when(k % 10 == 2, s + 0.03).when((k % 10 == 3) & (s > 1000), s + 0.5).when(k % 10 == 4, F.lit(None)).otherwise(s)
    )
    return orders.select("k", "o_orderpriority", value.alias("declared"))


_STATUS = """CASE WHEN declared IS NULL OR n = 0 THEN 'not_validatable' WHEN abs(round(declared - s, 6)) <= 0.05 THEN 'ok' WHEN abs(round(declared - s, 6)) <= greatest(0.05, abs(declared) * 0.001) THEN 'ok_with_rounding' WHEN s < declared THEN 'component_sum_lower_than_principal' ELSE 'component_sum_greater_than_principal' END"""
_BASE = f"""WITH q AS ({_SUMS}), d AS (SELECT o_orderkey AS k, o_orderpriority, q.s AS raw, coalesce(q.s, 0) AS s, coalesce(q.n, 0) AS n FROM orders LEFT JOIN q ON q.k = o_orderkey), e AS (SELECT k, o_orderpriority, s, n, {_DECLARED.replace("s IS NULL", "raw IS NULL")} AS declared FROM d), st AS (SELECT *, {_STATUS} AS status FROM e)"""


@query(f"{_BASE} SELECT k, round(declared, 3) AS declared, round(s, 3) AS component_sum, n AS n_rows, status FROM st")
def component_math_status(spark, sf_dir):
    out = reconcile.component_status(declared(spark, sf_dir).select("k", "declared"), components(spark, sf_dir), "k", "declared", "amount")
    return out.select("k", F.round("declared", 3).alias("declared"), F.round("component_sum", 3).alias("component_sum"), "n_rows", "status")


@query(f"{_BASE} SELECT o_orderpriority, status, count(*) AS n, CASE WHEN status LIKE 'component_sum%' THEN 'P1' ELSE 'P3' END AS priority FROM st GROUP BY 1, 2")
def block_triage(spark, sf_dir):
    d = declared(spark, sf_dir)
    out = reconcile.component_status(d.select("k", "declared"), components(spark, sf_dir), "k", "declared", "amount").join(d.select("k", "o_orderpriority"), "k")
    out = out.withColumn("t", reconcile.triage(F.col("status"), F.col("missing_totals")))
    return out.groupBy("o_orderpriority", "status", F.col("t.priority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_BASE}, g AS (SELECT k, round(declared - s, 6) AS delta FROM st WHERE status LIKE 'component_sum%'), r AS (SELECT l_orderkey AS k, l_partkey, l_linenumber, {AMOUNT} AS amount FROM lineitem)
SELECT k, l_partkey, l_linenumber, amount, CASE WHEN delta < 0 THEN 'removal_closes_sum' ELSE 'value_equals_delta' END AS why FROM r JOIN g USING (k) WHERE abs(amount - abs(delta)) <= 30""")
def mismatch_rows(spark, sf_dir):
    rows = components(spark, sf_dir)
    out = reconcile.component_status(declared(spark, sf_dir), rows, "k", "declared", "amount")
    return reconcile.closing_rows(rows, out, "k", "amount", 30.0).select("k", "l_partkey", "l_linenumber", "amount", "why")


@query(f"""WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT p_partkey, p_retailprice, n FROM part LEFT JOIN c ON l_partkey = p_partkey)
SELECT s.p_partkey, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'not_applicable_no_components' WHEN s.p_partkey % 4 = 1 THEN 'mismatch' WHEN s.p_partkey % 4 = 2 THEN 'insufficient_principal_value' ELSE 'ok' END AS status FROM s""")
def cost_reconciliation(spark, sf_dir):
    """Components are equal shares of the retail price, so that only the declared value decides."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    parts = table(spark, sf_dir, "part").join(lines, F.col("l_partkey") == F.col("p_partkey"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    k = F.col("p_partkey") % 4
    expected = F.when(k == 2, F.lit(None)).otherwise(F.col("p_retailprice") + F.when(k == 0, 0.05).when(k == 1, 0.2).otherwise(0.0))
    return parts.select("p_partkey", "n", reconcile.cost_status(expected, F.col("p_retailprice"), F.col("n")).alias("status"))


@query("""SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, round(l_quantity * u, 3) AS expected, CASE WHEN p IS NULL THEN NULL WHEN l_orderkey % 5 = 0 THEN 'warning' ELSE 'ok' END AS status, CASE WHEN p IS NULL THEN true ELSE l_orderkey % 5 <> 0 END AS strict_ok FROM (
  SELECT *, p_retailprice AS u, CASE WHEN l_orderkey % 7 = 0 THEN NULL WHEN l_orderkey % 5 = 0 THEN l_quantity * p_retailprice * 1.01 + 1 ELSE l_quantity * p_retailprice END AS p FROM lineitem JOIN part ON l_partkey = p_partkey)""")
def budget_math(spark, sf_dir):
    k = F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    q, u = F.col("l_quantity"), F.col("p_retailprice")
    p = F.when(k % 7 == 0, F.lit(None)).when(k % 5 == 0, q * u * 1.01 + 1).otherwise(q * u)
    rows = rows.withColumn("r", reconcile.triplet_report(q, F.when(k % 2 == 0, u), u, p)).withColumn("strict_ok", reconcile.item_triplet(q, u, p))
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", F.round(q * u, 3).alias("expected"), "r.status", "strict_ok")


def tree(spark, sf_dir):
    """Regions, nations and customers as a numbered tree, with totals that nations and regions declare."""
    cents = lambda c: F.round(c, 2).cast("decimal(18,2)")
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    item = lambda *c: F.concat_ws(".", *[(x + 1).cast("string") for x in c])
    r, n, c = F.col("n_regionkey"), F.col("n_nationkey"), F.col("c_custkey")
    leaves = customers.select(item(r, n, c).alias("item"), F.lit(True).alias("is_leaf"), cents(F.col("c_acctbal")).alias("amount"), F.lit(None).cast("decimal(18,2)").alias("declared"))
    nations = customers.groupBy("n_regionkey", "n_nationkey").agg(F.sum(cents(F.col("c_acctbal"))).alias("s"))
    shown = F.when(n % 5 == 0, F.lit(None)).when(n % 5 == 1, F.col("s") + 1).otherwise(F.col("s"))
    middle = nations.select(item(r, n).alias("item"), F.lit(False).alias("is_leaf"), F.lit(None).cast("decimal(18,2)").alias("amount"), shown.cast("decimal(18,2)").alias("declared"))
    regions = nations.groupBy("n_regionkey").agg(F.sum("s").alias("s"))
    top = regions.select(item(r).alias("item"), F.lit(False).alias("is_leaf"), F.lit(None).cast("decimal(18,2)").alias("amount"), F.when(r == 2, F.lit(None)).otherwise(F.col("s")).cast("decimal(18,2)").alias("declared"))
    return leaves.unionByName(middle).unionByName(top).withColumn("doc_id", F.lit(1)).withColumns({"amount": F.col("amount").cast("double"), "declared": F.col("declared").cast("double")})


_TREE = """WITH c AS (SELECT n_regionkey AS r, n_nationkey AS n, c_custkey, CAST(round(c_acctbal, 2) AS DECIMAL(18,2)) AS a FROM customer JOIN nation ON c_nationkey = n_nationkey),
nn AS (SELECT r, n, sum(a) AS s, count(*) AS k, CASE WHEN n % 5 = 0 THEN NULL WHEN n % 5 = 1 THEN sum(a) + 1 ELSE sum(a) END AS d FROM c GROUP BY 1, 2),
rr AS (SELECT r, sum(s) AS s, sum(coalesce(d, s)) AS own, count(*) AS k, CASE WHEN r = 2 THEN NULL ELSE sum(s) END AS d FROM nn GROUP BY 1)"""


@query(f"""{_TREE} SELECT CAST(r + 1 AS VARCHAR) || '.' || CAST(n + 1 AS VARCHAR) AS item, round(s, 2)::DOUBLE AS child_sum, CASE WHEN d IS NULL THEN 'total_missing' WHEN abs(s - d) <= greatest(0.05, abs(d) * 0.0001) THEN 'ok' ELSE 'mismatch' END AS status FROM nn
UNION ALL SELECT CAST(r + 1 AS VARCHAR), round(s, 2)::DOUBLE, CASE WHEN d IS NULL THEN 'total_missing' ELSE 'ok' END FROM rr""")
def hierarchy_leaf_rollup(spark, sf_dir):
    return reconcile.leaf_rollup(tree(spark, sf_dir)).select("item", F.round("child_sum", 2).alias("child_sum"), "status")


@query(f"""{_TREE} SELECT CAST(r + 1 AS VARCHAR) || '.' || CAST(n + 1 AS VARCHAR) AS item, round(s, 2)::DOUBLE AS child_sum, k AS children, CASE WHEN d IS NULL THEN 'parent_total_missing' WHEN abs(s - d) <= 0.08 THEN 'ok' ELSE 'mismatch' END AS status FROM nn
UNION ALL SELECT CAST(r + 1 AS VARCHAR), round(own, 2)::DOUBLE, k, CASE WHEN d IS NULL THEN 'parent_total_missing' WHEN abs(own - d) <= 0.08 THEN 'ok' ELSE 'mismatch' END FROM rr""")
def hierarchy_declared_rollup(spark, sf_dir):
    nodes = tree(spark, sf_dir).withColumn("declared", F.coalesce("declared", "amount"))
    return reconcile.declared_rollup(nodes, 3).select("item", F.round("child_sum", 2).alias("child_sum"), "children", "status")


@query("""WITH nn AS (SELECT n_regionkey AS r, n_nationkey AS n, sum(CAST(round(c_acctbal, 2) AS DECIMAL(18,2))) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT r, min(n) AS from_child, sum(s)::DOUBLE AS moved_total FROM nn WHERE r % 2 = 0 GROUP BY r""")
def subtotal_owner_repair(spark, sf_dir):
    """The first nation of every other region has the region's total printed on it."""
    nations = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    nations = nations.groupBy(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("child")).agg(F.sum(F.round("c_acctbal", 2).cast(DECIMAL)).cast("double").alias("child_sum"))
    sums = nations.groupBy("r").agg(F.round(F.sum("child_sum"), 2).alias("parent_sum"), F.min("child").alias("first"))
    parents = sums.select("r", "parent_sum", F.lit(None).cast("double").alias("parent_total"))
    groups = nations.join(sums, "r").select("r", "child", F.col("child").alias("ord"), "child_sum", F.when((F.col("child") == F.col("first")) & (F.col("r") % 2 == 0), F.col("parent_sum")).alias("child_total"))
    return reconcile.move_subtotals(groups, parents, "r")


def gappy_parts(spark, sf_dir):
    """Parts whose brand or type is missing here and there; parts of one retail step share both."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        "p_partkey", (k % 50).cast("string").alias("code"), F.floor(k / 50).cast("string").alias("lot"),
        F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("U"), (k % 50).cast("string"))).alias("und"), F.when(k % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("D"), F.floor(k / 50).cast("string"))).alias("descricao"), F.when(k % 5 == 0, "").otherwise("1").alias("quant"),
    )


@query("""SELECT p_partkey, 'U' || CAST(p_partkey % 50 AS VARCHAR) AS und, 'D' || CAST(p_partkey // 50 AS VARCHAR) AS descricao, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '1' END AS quant FROM part""")
def fixpoint_fill(spark, sf_dir):
    rows, _ = repair.to_fixpoint(gappy_parts(spark, sf_dir), "p_partkey", ["code", "lot"], ["und", "descricao"])
    return rows.select("p_partkey", "und", "descricao", "quant")


@query("""SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, CASE WHEN l_linenumber % 4 = 0 OR l_partkey % 11 = 0 THEN 'unresolved' WHEN l_orderkey % 6 = 0 OR l_suppkey % 9 = 0 THEN 'closed_with_warning' ELSE 'closed_100' END AS status FROM lineitem""")
def row_status(spark, sf_dir):
    c = F.col
    rows = table(spark, sf_dir, "lineitem").withColumns({"und": F.when(c("l_linenumber") % 4 == 0, "").otherwise("UN"), "total": F.lit("1,00")})
    math = F.when(c("l_orderkey") % 6 == 0, "mismatch").otherwise("ok")
    issue = F.when(c("l_partkey") % 11 == 0, "arrow_marker").otherwise("")
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", repair.row_status(reconcile.missing_fields("und", "total"), math, issue, c("l_suppkey") % 9 == 0).alias("status"))
