"""Cutting a result off from how it came about."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> None:
    """Sees to it that checkpoints go to the folder that the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a session on one machine gets a temporary one, and a cluster an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="ledgerloom-"))


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared checkpoint folder.

    What is kept there goes with the last reference to it if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.

    A checkpointed DataFrame hands on the size its plan was thought to give.  A join
    multiplies such sizes, so that in a loop of joins the number grows to millions of
    digits, and planning with it; therefore the rows are taken up anew, without it.
    """
    spark = df.sparkSession
    checkpoint_folder(spark)
    kept = df.checkpoint(eager=True)
    return DataFrame(spark._jsparkSession.createDataFrame(kept._jdf.toJavaRDD(), kept._jdf.schema()), spark)
