"""Sinks: the public projection, JSON views and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import public_text

#: Columns that belong to the run and not to the result.
RUNTIME = ("debug", "runtime", "cache", "timing", "calc_total", "calc_unit")


def public(df: DataFrame) -> DataFrame:
    """Without runtime columns; doubles as public numbers."""
    cols = [c for c in df.dtypes if c[0] not in RUNTIME and not c[0].startswith("_")]
    return df.select(*[public_text(F.col(c)).alias(c) if kind == "double" else F.col(c) for c, kind in cols])


def without_empty(c: Column) -> Column:
    """A map without null and empty values."""
    return F.map_filter(c, lambda k, v: v.isNotNull() & (v != ""))


def json_view(df: DataFrame, key: str, order: list[str], name: str = "rows") -> DataFrame:
    """One JSON text for each key, its rows in order; a key is one document or block."""
    body = F.struct(*[F.col(c) for c in df.columns if c != key])
    rows = F.transform(F.array_sort(F.collect_list(F.struct(*order, body.alias("body")))), lambda r: r["body"])
    return df.groupBy(key).agg(rows.alias(name)).select(key, F.to_json(F.struct(name)).alias("json"))


def write_relations(relations: dict[str, DataFrame], path: str, partition_by: str | None = None) -> None:
    """Each relation as a Parquet table below ``path``."""
    for name, df in relations.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by and partition_by in df.columns else writer).parquet(f"{path}/{name}")
