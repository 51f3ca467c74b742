"""Declared totals against the sums of their parts.

Calculated values rank, validate or block; they are never written to a public
column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import is_empty


def line_total(total: Column, quantity: Column, unit_price: Column) -> Column:
    """The printed total, or quantity times price where none is printed."""
    return F.coalesce(total, F.round(quantity * unit_price, 6))


def sum_status(declared: Column, total: Column, rows: Column, special: Column | None = None, tol_abs: float = 0.05, tol_rel: float = 0.001) -> Column:
    """Six statuses of a declared total against the sum of its components."""
    delta = F.abs(F.round(declared - total, 6))
    tolerance = F.greatest(F.lit(tol_abs), F.abs(declared) * F.lit(tol_rel))
    out = F.when(declared.isNull() | (rows == 0), "not_validatable")
    if special is not None:
        out = F.when(special, "sicro_special_case").when(declared.isNull() | (rows == 0), "not_validatable")
    return out.when(delta <= tol_abs, "ok").when(delta <= tolerance, "ok_with_rounding").when(total < declared, "component_sum_lower_than_principal").otherwise("component_sum_greater_than_principal")


def component_status(principals: DataFrame, components: DataFrame, key: str, declared: str, amount: str, summary: Column | None = None, tol_abs: float = 0.05, tol_rel: float = 0.001) -> DataFrame:
    """One row for each principal: its declared total, the sum of its components and the status.

    ``summary`` marks component rows that sum up others and are left out.  Sums are
    combined before the shuffle, so a block with most rows is no hot spot.
    """
    rows = components if summary is None else components.where(~summary)
    sums = rows.groupBy(key).agg(F.sum(amount).alias("component_sum"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(amount).isNull()).alias("missing_totals"))
    out = principals.select(key, F.col(declared).alias("declared")).join(sums, key, "left")
    out = out.withColumns({"component_sum": F.coalesce(F.round("component_sum", 6), F.lit(0.0)), "n_rows": F.coalesce("n_rows", F.lit(0)), "missing_totals": F.coalesce("missing_totals", F.lit(0))})
    return out.withColumns({"delta": F.round(F.col("declared") - F.col("component_sum"), 6), "status": sum_status(F.col("declared"), F.col("component_sum"), F.col("n_rows"), None, tol_abs, tol_rel)})


def block_status(rows: DataFrame, keys: list[str], principal: Column, amount: str, tol_abs: float = 0.05, tol_rel: float = 0.001) -> DataFrame:
    """``component_status`` of blocks that hold their principal row too, in one pass; the largest amount of a block's principals is the declared one."""
    own, part = F.when(principal, F.col(amount)), ~principal
    out = rows.groupBy(*keys).agg(
        F.count_if(principal).alias("principals"), F.max(own).alias("declared"), F.sum(F.when(part, F.col(amount))).alias("component_sum"), F.count_if(part).alias("n_rows"), F.count_if(part & F.col(amount).isNull()).alias("missing_totals"),
    ).where("principals > 0").drop("principals")
    out = out.withColumn("component_sum", F.coalesce(F.round("component_sum", 6), F.lit(0.0)))
    return out.withColumns({"delta": F.round(F.col("declared") - F.col("component_sum"), 6), "status": sum_status(F.col("declared"), F.col("component_sum"), F.col("n_rows"), None, tol_abs, tol_rel)})


def cost_status(expected: Column, total: Column, rows: Column, tolerance: float = 0.08) -> Column:
    """The simpler check of a unit value: no rounding tolerance, no summary rows."""
    return F.when(rows == 0, "not_applicable_no_components").when(expected.isNull(), "insufficient_principal_value").when(F.abs(F.round(total - expected, 6)) <= tolerance, "ok").otherwise("mismatch")


def item_triplet(q: Column, u: Column, p: Column, tol_abs: float = 0.02, tol_rel: float = 0.0002) -> Column:
    """Quantity times unit price against the printed part; numbers that cannot be read pass."""
    expected = q * u
    ok = F.abs(expected - p) <= F.greatest(F.lit(tol_abs), F.abs(expected) * F.lit(tol_rel))
    return F.coalesce(ok, F.lit(True))


def triplet_report(q: Column, with_bdi: Column, without_bdi: Column, p: Column, tol_abs: float = 0.05, tol_rel: float = 0.002) -> Column:
    """expected, difference, relative difference, status and action; the price without BDI stands in for a missing one.  Null if a number is missing."""
    u = F.coalesce(with_bdi, without_bdi)
    expected = q * u
    diff = F.abs(expected - p)
    rel = diff / F.greatest(F.abs(p), F.abs(expected), F.lit(1.0))
    ok = (diff <= tol_abs) | (rel <= tol_rel)
    return F.when(
        expected.isNotNull() & p.isNotNull(),
        F.struct(
            F.round(expected, 4).alias("expected"), F.round(diff, 4).alias("difference"), F.round(rel, 6).alias("relative_difference"),
            F.when(ok, "ok").otherwise("warning").alias("status"), F.when(ok, "keep").otherwise("targeted_recheck_candidate").alias("action"),
        ),
    )


def level_of(item: Column) -> Column:
    """Depth of a dotted item number."""
    return F.size(F.split(item, r"\."))


def parent_of(item: Column) -> Column:
    return F.when(F.contains(item, F.lit(".")), F.regexp_replace(item, r"\.[^.]*$", ""))


def ancestors(item: Column) -> Column:
    """The item numbers above, from the top."""
    parts = F.split(item, r"\.")
    up = F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))
    return F.when(F.size(parts) > 1, F.transform(up, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).otherwise(F.array().cast("array<string>"))


def leaf_rollup(nodes: DataFrame, doc: str = "doc_id", item: str = "item", is_leaf: str = "is_leaf", amount: str = "amount", declared: str = "declared", tol_abs: float = 0.05, tol_rel: float = 0.0001) -> DataFrame:
    """Every group's declared total against the sum of the leaves below it, at any depth.

    Each leaf is sent to its ancestors and summed there, in one shuffle for all levels.
    """
    leaves = nodes.where(F.col(is_leaf)).select(doc, F.explode(ancestors(F.col(item))).alias(item), F.coalesce(F.col(amount), F.lit(0.0)).alias("a"))
    sums = leaves.groupBy(doc, item).agg(F.sum("a").alias("child_sum"))
    out = nodes.where(~F.col(is_leaf)).select(doc, item, declared).join(sums, [doc, item], "left").withColumn("child_sum", F.coalesce("child_sum", F.lit(0.0)))
    diff = F.col("child_sum") - F.col(declared)
    tolerance = F.greatest(F.lit(tol_abs), F.abs(F.col(declared)) * F.lit(tol_rel))
    return out.withColumn("status", F.when(F.col(declared).isNull(), "total_missing").when(F.abs(diff) <= tolerance, "ok").otherwise("mismatch")).withColumn("delta", F.round(diff, 6))


def declared_rollup(nodes: DataFrame, depth: int, doc: str = "doc_id", item: str = "item", declared: str = "declared", tolerance: float = 0.08) -> DataFrame:
    """Every parent's declared total against its children, each with its own declared total or else its own sum.

    An error does not travel up past a declared total.  One shuffle a level, from
    the deepest; ``depth`` is the deepest level.
    """
    rows = nodes.select(doc, F.col(item).alias("item"), F.col(declared).alias("declared"))
    level = level_of(F.col("item"))
    below = None
    reports = []
    for at in range(depth, 0, -1):
        here = rows.where(level == at)
        if below is None:
            value = here.select(doc, "item", F.coalesce("declared", F.lit(0.0)).alias("value"))
        else:
            sums = below.groupBy(doc, F.col("parent").alias("item")).agg(F.sum("value").alias("child_sum"), F.count(F.lit(1)).alias("children"))
            here = here.join(sums, [doc, "item"], "left")
            reports.append(here.where("children is not null").select(doc, "item", "declared", F.round("child_sum", 6).alias("child_sum"), "children"))
            value = here.select(doc, "item", F.coalesce("declared", "child_sum", F.lit(0.0)).alias("value"))
        below = value.withColumn("parent", parent_of(F.col("item")))
    out = reports[0]
    for more in reports[1:]:
        out = out.unionByName(more)
    delta = F.col("child_sum") - F.col("declared")
    return out.withColumn("status", F.when(F.col("declared").isNull(), "parent_total_missing").when(F.abs(delta) <= tolerance, "ok").otherwise("mismatch"))


def move_subtotals(groups: DataFrame, parents: DataFrame, key: str, tolerance: float = 0.08) -> DataFrame:
    """Totals that stand on a child but are the parent's: moved up, as patches.

    ``groups``: one row a child, with its printed total, the sum of its own leaves
    and its order under the parent.  ``parents``: their total, null if none is
    printed, and the sum of all leaves below.  A child's total moves if its parent
    has none, it is not the child's own sum and it is the parent's; the first such child gives.
    """
    rows = groups.join(parents, key)
    fits = rows["parent_total"].isNull() & (F.abs(rows["child_total"] - rows["parent_sum"]) <= tolerance) & (F.abs(rows["child_total"] - rows["child_sum"]) > tolerance)
    return rows.where(fits).groupBy(key).agg(F.min_by(F.struct("child", "child_total"), F.struct("ord", "child")).alias("m")).select(key, F.col("m.child").alias("from_child"), F.col("m.child_total").alias("moved_total"))


def triage(status: Column, missing: Column) -> Column:
    """Suspected causes and priority of a block, from its status and how many fields are missing."""
    causes = F.array_compact(
        F.array(
            F.when(missing > 0, F.lit("missing_fields")),
            F.when(status == "component_sum_lower_than_principal", F.lit("missing_component_row")),
            F.when(status == "component_sum_greater_than_principal", F.lit("duplicate_or_foreign_row")),
            F.when(status == "not_validatable", F.lit("principal_or_components_missing")),
        )
    )
    priority = F.when((missing > 0) & status.startswith("component_sum"), "P0").when(status.startswith("component_sum"), "P1").when(missing > 0, "P2").otherwise("P3")
    return F.struct(causes.alias("causes"), priority.alias("priority"))


def closing_rows(components: DataFrame, statuses: DataFrame, key: str, amount: str, tolerance: float = 0.05) -> DataFrame:
    """Rows that alone explain a wrong sum: their amount is the surplus, or what is lacking."""
    bad = statuses.where(F.col("status").startswith("component_sum")).select(key, "delta")
    rows = components.join(bad, key)
    gap = F.abs(F.col("delta"))
    why = F.when((F.col("delta") < 0) & (F.abs(F.col(amount) - gap) <= tolerance), "removal_closes_sum").when((F.col("delta") > 0) & (F.abs(F.col(amount) - gap) <= tolerance), "value_equals_delta")
    return rows.withColumn("why", why).where("why is not null")


def missing_fields(*fields: str) -> Column:
    """Names of the empty ones among text fields."""
    return F.array_compact(F.array(*[F.when(is_empty(F.col(f)), F.lit(f)) for f in fields]))
