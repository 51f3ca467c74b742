"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..lineage import cut  # noqa: F401

#: A word, in the sense of every contract here, is a run of bytes other than these.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """How many shuffle partitions the cluster's operator has set for this size of data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the two columns an operator needs, so that others cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def with_column(schema: StructType, name: str, kind: str) -> StructType:
    """A new schema with one more column (``StructType.add`` changes its own)."""
    return StructType(list(schema.fields)).add(name, kind)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a variation that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let_go(spark: SparkSession) -> None:
    """Frees the disk of shuffles and checkpoints that nothing refers to any more; Spark finds them when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


#: Rows up to which a table that has just been counted is broadcast.
SMALL_ROWS = 20_000


def small(df: DataFrame, most_rows: int = SMALL_ROWS) -> DataFrame:
    """``df``, which has been ``cut``, marked for broadcast if it has few rows, else as it is."""
    return F.broadcast(df) if len(df.limit(most_rows + 1).select(F.lit(1)).collect()) <= most_rows else df


#: Rows that a task takes before it works on the groups among them.
CHUNK = 150_000


def whole_groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[np.ndarray]:
    """The rows of batches of numbers sorted by their first ``by`` columns, some at a time, no group of equal ones divided."""
    held: list[np.ndarray] = []
    n, most = 0, CHUNK
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))
        n += batch.num_rows
        if n >= most:  # all groups but the last, which may go on
            x = np.concatenate(held)
            last = int(np.flatnonzero((x[:, :by] != x[-1, :by]).any(axis=1)).max(initial=-1)) + 1
            if last:
                yield x[:last]
            held, n = [x[last:]], len(x) - last
            most = max(CHUNK, 2 * n)
    if n:
        yield np.concatenate(held)
