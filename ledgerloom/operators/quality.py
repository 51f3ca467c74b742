"""Gates, coverage, accuracy and counts over what was extracted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gate(violations: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Counts of each violation with its severity; the result passes if none is blocking.

    Everything is counted; only a view of it may be cut to a number of examples.
    """
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), "n") for code, (df, severity) in violations.items()]
    return reduce(lambda a, b: a.unionByName(b), parts).withColumn("blocks", (F.col("severity") == "blocking") & (F.col("n") > 0))


def passes(report: DataFrame) -> DataFrame:
    return report.agg((F.count_if("blocks") == 0).alias("ok"), F.sum(F.when(F.col("severity") == "blocking", F.col("n")).otherwise(0)).alias("blocking"), F.sum(F.when(F.col("severity") == "warning", F.col("n")).otherwise(0)).alias("warnings"))


def coverage(expected: DataFrame, found: DataFrame, key: str, by: list[str]) -> DataFrame:
    """How many of the expected keys were found, and the rate."""
    seen = found.select(key).distinct().withColumn("seen", F.lit(1))
    out = expected.select(key, *by).join(seen, key, "left")
    return out.groupBy(*by).agg(F.count(F.lit(1)).alias("expected"), F.count("seen").alias("found"), F.round(F.count("seen") / F.count(F.lit(1)), 6).alias("rate"))


def inventory(expected: DataFrame, extracted: DataFrame, key: str) -> DataFrame:
    """Rows printed against rows extracted, for each block: too few is a failure, too many is not."""
    out = expected.groupBy(key).agg(F.count(F.lit(1)).alias("printed")).join(extracted.groupBy(key).agg(F.count(F.lit(1)).alias("extracted")), key, "left")
    got = F.coalesce("extracted", F.lit(0))
    return out.select(key, "printed", got.alias("extracted"), F.when(got < F.col("printed"), "under").when(got > F.col("printed"), "over").otherwise("equal").alias("state"))


def field_accuracy(expected: DataFrame, actual: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """For each field how many expected values were given rightly, wrongly or not at all."""
    a = actual.select(key, *[F.col(f).cast("string").alias(f"a_{f}") for f in fields])
    both = expected.select(key, *[F.col(f).cast("string").alias(f"e_{f}") for f in fields]).join(a, key, "left")
    rows = both.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"e_{f}").alias("e"), F.col(f"a_{f}").alias("a")) for f in fields])).alias("x")).where("x.e is not null")
    return rows.groupBy("x.field").agg(
        F.count(F.lit(1)).alias("expected"), F.count_if(F.col("x.e") == F.col("x.a")).alias("correct"), F.count_if(F.col("x.a").isNull()).alias("missing"), F.round(F.count_if(F.col("x.e") == F.col("x.a")) / F.count(F.lit(1)), 6).alias("accuracy")
    )


def confidence_tier(evidence: Column, conflicts: Column) -> Column:
    return F.when((evidence >= 2) & (conflicts == 0), "high").when((evidence >= 1) & (conflicts <= 1), "medium").otherwise("review")


def tier_score(tier: Column) -> Column:
    return F.when(tier == "high", 0.95).when(tier == "medium", 0.78).otherwise(0.45)


def two_axis_status(extraction_issues: Column, document_issues: Column) -> Column:
    """Was it read faithfully, and does the document add up: two different questions."""
    return F.struct(F.when(extraction_issues == 0, "faithful").otherwise("needs_review").alias("extraction"), F.when(document_issues == 0, "consistent").otherwise("document_warnings").alias("document"))


def occurrence_counts(df: DataFrame, dims: list[str], measures: list[Column]) -> DataFrame:
    """Counts for each dimension by itself and in total; which one a row is for stands in ``grouping``."""
    return df.groupingSets([[d] for d in dims] + [[]], *dims).agg(F.grouping_id(*dims).alias("grouping"), *measures)
