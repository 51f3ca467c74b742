"""Deduplication in a stated order, set differences and comparisons of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Of rows with equal keys the first in ``order``.

    The order should be total; the minimum is combined before the shuffle, so a key
    with most rows is no hot spot, as it would be for a window.
    """
    rows = df.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)).alias("r"))
    return rows.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in df.columns])


def except_by(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the other table has not."""
    return df.join(other.select(*keys).distinct(), keys, "left_anti")


def union_first(parts: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """The rows of several tables, of equal keys those of the earlier table; ``part`` says which."""
    rows = reduce(lambda a, b: a.unionByName(b), [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)])
    return first_by(rows, keys, ["part", *order])


def upsert(base: DataFrame, native: DataFrame, key: str, values: list[str], keep: list[str] = ()) -> DataFrame:
    """Rows of both; where both have a key, values of ``native`` that are there win, but those in ``keep`` stay."""
    b, n = base.select(key, *[F.col(v).alias(f"b_{v}") for v in [*values, *keep]], F.lit(True).alias("in_base")), native.select(key, *[F.col(v).alias(f"n_{v}") for v in [*values, *keep]], F.lit(True).alias("in_native"))
    out = b.join(n, key, "full_outer")
    chosen = [F.coalesce(F.col(f"n_{v}"), F.col(f"b_{v}")).alias(v) for v in values] + [F.coalesce(F.col(f"b_{v}"), F.col(f"n_{v}")).alias(v) for v in keep]
    origin = F.when(F.col("in_base") & F.col("in_native"), "replaced").when(F.col("in_native"), "inserted").otherwise("kept")
    return out.select(key, *chosen, F.coalesce(origin, F.lit("kept")).alias("origin"))


def field_diff(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Every field that two runs give differently, or that only one of them has."""
    side = lambda d, p: d.select(key, F.lit(True).alias(f"{p}_in"), *[F.col(f).cast("string").alias(f"{p}_{f}") for f in fields])
    both = side(left, "a").join(side(right, "b"), key, "full_outer")
    rows = both.select(key, "a_in", "b_in", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("a"), F.col(f"b_{f}").alias("b")) for f in fields])).alias("d"))
    kind = F.when(F.col("b_in").isNull(), "only_left").when(F.col("a_in").isNull(), "only_right").otherwise("changed")
    return rows.where(~F.col("d.a").eqNullSafe(F.col("d.b"))).select(key, "d.field", "d.a", "d.b", kind.alias("kind"))


def collection_of(item: Column) -> Column:
    """Blocks that a budget item names are principal, all others auxiliary."""
    return F.when(F.trim(F.coalesce(item, F.lit(""))) != "", "principais").otherwise("auxiliares_globais")


def missing_keys(have: Column, required: list[str], forbidden: list[str] = ()) -> Column:
    """Of an array of names: which required ones are missing and which forbidden ones are there."""
    return F.struct(
        F.array_except(F.array(*map(F.lit, required)), have).alias("missing"), F.array_intersect(have, F.array(*map(F.lit, forbidden)) if forbidden else F.array().cast("array<string>")).alias("forbidden")
    )
