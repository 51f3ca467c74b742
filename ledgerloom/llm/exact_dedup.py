"""Exact deduplication by a tree merge of sorted digest runs.

Every address (a slice of the document ids) starts with one sorted run of
digests.  In each round the addresses exchange parts of their runs: digit r of
an entry's address is replaced by digit r of its digest's address, so that a
round only merges ``RADIX`` runs.  After the last round all entries of a digest
stand at the digest's own address.  No address ever holds more than ``RADIX``
entries of one digest in one round, however many documents share the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, free_name, id_and_text, partitions, with_column

#: Runs merged at one address in one round.
RADIX = 8

_RUN = "addr int, digest binary, n_bytes long, best long, n long, sources array<int>"
_RUN_SCHEMA = pa.schema(
    [("addr", pa.int32()), ("digest", pa.binary()), ("n_bytes", pa.int64()), ("best", pa.int64()), ("n", pa.int64()), ("sources", pa.list_(pa.int32()))]
)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.lower() for t in as_bytes(batch.column("text"))]  # bytes.lower() changes A-Z only
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64())],
            names=["doc_id", "digest", "n_bytes"],
        )


def _merger(largest: bool):
    """Merges neighbours with the same digest of a partition sorted by address and digest."""

    def better(a: int | None, b: int | None) -> int | None:
        if a is None or b is None:
            return b if a is None else a
        return max(a, b) if largest else min(a, b)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_entry: list | None = None
        for batch in batches:
            done = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if open_entry is not None and row[:3] == tuple(open_entry[:3]):  # equal digest and length: the same text
                    open_entry[3] = better(open_entry[3], row[3])
                    open_entry[4] += row[4]
                    if open_entry[5] != row[5]:  # the same at the start, when all stand where they came from; apart afterwards
                        open_entry[5] += row[5]
                else:
                    if open_entry is not None:
                        done.append(open_entry)
                    open_entry = list(row)
            if done:
                yield _batch(done)
        if open_entry is not None:
            yield _batch([open_entry])

    return merge


def _batch(entries: list[list]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*entries), _RUN_SCHEMA)], schema=_RUN_SCHEMA)


def exact_groups(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: which copy of its text stays.

    Texts are equal if they are identical after lower-casing A-Z.  ``keep`` names
    the id that stays, ``min`` or ``max``.  Columns: doc_id, keep_id, group_size,
    kept, text_sha256, n_bytes.

    Null text counts as empty.  Repeated rows (same id and text) count in
    group_size, and one of them is kept.  A null id loses to any other; a group
    of null ids only keeps one of them.  No rows give no rows.
    """
    spark = docs.sparkSession
    p = partitions(spark)
    rounds = 1
    while RADIX**rounds < p:
        rounds += 1
    size = RADIX**rounds
    rows = id_and_text(docs, id_col, text_col).mapInArrow(_digests, "doc_id long, digest binary, n_bytes long")
    rows = cut(
        rows.groupBy("doc_id", "digest", "n_bytes")
        .agg(F.count(F.lit(1)).alias("m"))
        .withColumn("addr", F.pmod(F.xxhash64("doc_id"), F.lit(size)).cast("int"))
    )
    merge = _merger(keep == "max")
    run = rows.select("addr", "digest", "n_bytes", F.col("doc_id").alias("best"), F.col("m").alias("n"), F.array("addr").alias("sources"))
    run = _merged(run, p, merge)
    home = F.pmod(F.xxhash64("digest"), F.lit(size))
    for r in range(rounds):
        step = RADIX**r
        digit = lambda c: F.floor(c / step) % RADIX
        moved = (F.col("addr") + (digit(home) - digit(F.col("addr"))) * step).cast("int")
        run = _merged(run.withColumn("addr", moved), p, merge)
    shared = run.where("n > 1").select(F.explode("sources").alias("addr"), "digest", "n_bytes", "best", "n")
    out = rows.join(shared, ["addr", "digest", "n_bytes"], "left")
    kept_id = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best"))
    return out.select(
        "doc_id",
        kept_id.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.explode(F.expr("sequence(1L, m)")).alias("copy"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "n_bytes",
    ).select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256", "n_bytes")


def _merged(run: DataFrame, p: int, merge) -> DataFrame:
    return run.repartition(p, "addr").sortWithinPartitions("addr", "digest", "n_bytes").select("addr", "digest", "n_bytes", "best", "n", "sources").mapInArrow(merge, _RUN)


def drop_exact_copies(docs: DataFrame, keep: str = "max", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with the columns of ``docs``."""
    mark, own = free_name(docs, "sha"), free_name(docs, "own_id")
    schema = with_column(docs.schema, mark, "string")
    at = docs.columns.index(text_col)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha = [hashlib.sha256(t.lower()).hexdigest() for t in as_bytes(batch.column(at))]
            yield pa.record_batch([*batch.columns, pa.array(sha, pa.string())], names=[*batch.schema.names, mark])

    gone = exact_groups(docs, keep, id_col, text_col).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept")).where("not kept")
    gone = gone.select(F.col("doc_id").alias(own), F.col("text_sha256").alias(mark))
    rows = docs.mapInArrow(marked, schema)
    left = rows.join(gone, rows[id_col].cast("long").eqNullSafe(gone[own]) & (rows[mark] == gone[mark]), "left_anti")
    return left.dropDuplicates([id_col, mark]).select(*[left[c] for c in docs.columns])
