"""The engine's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: For DuckDB, with every table of the folder as a view.
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "component_math_status"


def query(sql: str | None = None):
    """Registers a plan under its name, with the SQL that must give the same rows."""

    def register(plan: Callable[[SparkSession, str], DataFrame]):
        QUERIES[plan.__name__] = plan
        if sql is not None:
            ORACLE_SQL[plan.__name__] = sql
        return plan

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt to all cores, if they stand in fewer pieces: a small file with one row group is read by one task."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


from . import evidence, links, numbers, quality, reconciliation, recovery, schemas, sequences, texts  # noqa: E402,F401
