"""Choosing among candidates: the best with the reasons against the others, or a few of each kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_with_reasons(df: DataFrame, keys: list[str], score: Column, rejects: dict[str, Column], tie: list[str]) -> DataFrame:
    """The best row of each group that no reject holds for, and how often each reject did."""
    marked = df.withColumns({"score": score, "reasons": F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rejects.items()]))})
    cols = [c for c in df.columns if c not in keys]
    ok = F.size("reasons") == 0
    best = F.max_by(F.when(ok, F.struct(*cols, "score")), F.when(ok, F.struct(F.col("score"), *[F.col(t) for t in tie])))
    out = marked.groupBy(*keys).agg(best.alias("b"), *[F.count_if(c).alias(f"n_{n}") for n, c in rejects.items()])
    return out.select(*keys, *[F.col(f"b.{c}").alias(c) for c in cols], "b.score", *[f"n_{n}" for n in rejects])


def template_score(base: Column, bonus_texts: Column, matched_required: Column, n_required: Column, header_hits: Column) -> Column:
    """How well a table template fits: .25 a bonus text, .35 a required column (.30 if there are over four), .1 a header."""
    weight = F.when(n_required > 4, 0.30).otherwise(0.35)
    return F.round(base + F.lit(0.25) * bonus_texts + weight * matched_required + F.lit(0.1) * header_hits, 6)


def table_score(header: Column, content: Column, geometry: Column, semantic: Column, strategy: Column) -> Column:
    bonus = F.when(strategy == "lines", 0.6).when(strategy == "bands", 0.4).otherwise(0.0)
    return F.round(F.lit(1.8) * header + content + geometry + F.lit(4.0) * semantic + bonus, 6)


def least_bad(variants: DataFrame, keys: list[str], variant: str = "variant") -> DataFrame:
    """The variant of a block with rows, then the least arithmetic distance, then fewest missing fields, most rows, most pages."""
    order = F.struct((F.col("n_rows") == 0).cast("int"), F.col("distance"), F.col("missing"), -F.col("n_rows"), -F.col("n_pages"), F.col(variant))
    return variants.groupBy(*keys).agg(F.min_by(F.struct(variant, "n_rows", "distance", "missing"), order).alias("m")).select(*keys, f"m.{variant}", "m.n_rows", "m.distance", "m.missing")


def engine_score(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of several extractions of a document the best productive one; diagnostic ones are scored and never win."""
    score = (
        200 * F.col("compositions") + 8 * F.col("n_rows") + 12 * F.col("sections") + 50 * F.col("confidence") - 300 * F.col("issues") - 500 * F.col("contract") - 30 * F.col("no_evidence") - 120 * F.col("math_failures")
    )
    rows = df.withColumn("score", score).where(F.col("profile") == "production")
    return rows.groupBy(*keys).agg(F.max_by(F.struct("engine", "score"), F.struct("score", "engine")).alias("m")).select(*keys, "m.engine", "m.score")


def hypothesis_score(base_hits: Column, unit_ok: Column, gap: Column, polluted: Column, truncated: Column) -> Column:
    """Of a text put together from lines: .56, better with hits, worse with gaps; from 0 to .99."""
    score = F.lit(0.56) + F.lit(0.08) * base_hits + F.when(unit_ok, 0.12).otherwise(0.0) - F.when(polluted, 0.4).otherwise(0.0) - F.when(truncated, 0.15).otherwise(0.0) - F.least(gap / 100, F.lit(0.2))
    return F.greatest(F.lit(0.0), F.least(F.lit(0.99), score))


def top_of_each(df: DataFrame, bucket: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each bucket: a report's limit, by a total order."""
    w = Window.partitionBy(*bucket).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def priority(missing_critical: Column, missing_other: Column, math_wrong: Column, text_weak: Column) -> Column:
    return F.when(missing_critical > 0, "P0").when((missing_other > 0) | math_wrong, "P1").when(text_weak, "P2").otherwise("P3")
