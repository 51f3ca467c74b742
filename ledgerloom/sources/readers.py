"""Sources: pages, lines, words and table structures as relations.

Decoding PDF files needs a library that is not part of this engine; readers start
from exploded words, lines or page texts, or from files whose decoder is given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from ..functions.numeric import clean

PAGES = StructType([StructField("doc_id", StringType()), StructField("page", IntegerType()), StructField("text", StringType())])
WORDS = StructType([StructField("doc_id", StringType()), StructField("page", IntegerType()), *[StructField(c, DoubleType()) for c in ("x0", "y0", "x1", "y1")], StructField("text", StringType())])
COLUMN = StructType([StructField("canonical", StringType()), StructField("header", StringType()), StructField("x0", DoubleType()), StructField("x1", DoubleType()), StructField("confidence", DoubleType())])
TABLES = StructType(
    [
        StructField("tables", ArrayType(StructType([StructField("table_id", StringType()), StructField("page", IntegerType()), StructField("family", StringType()), StructField("columns", ArrayType(COLUMN)), StructField("rows", ArrayType(ArrayType(StringType())))])))
    ]
)


def decoded_pages(spark: SparkSession, path: str, decode: Callable[[bytes], list[str]], glob: str = "*.pdf") -> DataFrame:
    """doc_id, page and text of every file below ``path``; ``decode`` gives a file's page texts.  A file is read by one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                texts = decode(content or b"")
                yield pa.record_batch([pa.array([name] * len(texts), pa.string()), pa.array(range(1, len(texts) + 1), pa.int32()), pa.array(texts, pa.string())], names=PAGES.names)

    return files.mapInArrow(explode, PAGES)


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGES).parquet(path)


def words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WORDS).parquet(path)


def page_range(pages: DataFrame, first: int, last: int) -> DataFrame:
    """Pages from first to last; the filter reaches the scan."""
    return pages.where(F.col("page").between(first, last))


def page_subset(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """The pages that are listed, with doc_id and page."""
    return pages.join(wanted.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi")


def line_rows(pages: DataFrame, text: str = "text") -> DataFrame:
    """One row for each line that is not empty, numbered from 0 within its page; numbers count empty lines too."""
    rows = pages.select(*[c for c in pages.columns if c != text], F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line"))
    return rows.withColumn("line", clean(F.col("line"))).where("line <> ''")


def table_structures(spark: SparkSession, path: str) -> DataFrame:
    """One row for each table of a JSON payload."""
    rows = spark.read.schema(TABLES).option("multiLine", True).json(path)
    return rows.select(F.explode("tables").alias("t")).select("t.*")


def structure_columns(tables: DataFrame) -> DataFrame:
    """One row for each column of a table."""
    return tables.select("table_id", "page", "family", F.posexplode("columns").alias("col_index", "c")).select("table_id", "page", "family", "col_index", "c.*")


def structure_cells(tables: DataFrame) -> DataFrame:
    """One row for each cell."""
    rows = tables.select("table_id", F.posexplode("rows").alias("row", "cells"))
    return rows.select("table_id", "row", F.posexplode("cells").alias("col", "text"))


def content_key(*parts) -> "F.Column":
    """A key that equal contents share, whatever the order of their fields was."""
    return F.sha2(F.to_json(F.struct(*sorted(parts))), 256)


def layered(base: dict, *overlays: dict) -> dict:
    """Settings merged deep; later ones win, lists are replaced whole."""
    out = dict(base)
    for overlay in overlays:
        for k, v in overlay.items():
            out[k] = layered(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
