"""Mixing sources to target weights by repeating documents.

The words of every source are summed first; a source's target over its size is
its repetition rate.  A document is then taken floor(rate) times, and once more
if its seeded hash falls below the fraction.  Neither step looks at any other
document, so a source that holds most rows is no hot spot: sums are combined
before the shuffle, and the documents are not shuffled by source at all when
the table of rates is measured to be small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, free_name, small

#: Weights dealt to the sources in code-point order, over and over.
WEIGHTS = (5, 2, 1)
#: Size of the mix as a share of all words, and the most a source may be repeated.
TOTAL_SHARE = 1.5
MAX_REPEATS = 2
SEED = "mix-1"


def words(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, most: float = MAX_REPEATS) -> DataFrame:
    """``sizes`` (source, source_size, one row each) with each source's target.

    Sources weigh ``weights`` in turn, ordered by code point with null last, and
    divide ``share`` of all words; a target stops at ``most`` times its source,
    and what is left over is divided again among the others by weight.

    The level at which that ends has a closed form: sources sorted by
    most * size / weight are full one after the other, and with k full ones the
    others get (total - what the full ones take) / (their weights) a unit of
    weight.  The first k for which the next source is not full is right.
    Sources without a word get 0.  This is one row a source, not a document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    out = sizes.withColumn("weight", F.element_at(turn, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    out = out.withColumn("most", F.lit(float(most)) * F.col("source_size"))
    by_limit = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    out = (
        out.withColumn("full", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("open_weight"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("most"))
    )
    out = out.withColumn("chosen", F.min(F.when(F.col("fits"), F.struct(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(everything))
    target = F.when(F.col("chosen").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("chosen.level") * F.col("weight")))
    return out.select("source", "source_size", target.alias("target"))


def chance(id_col: str = "doc_id", seed: str = SEED):
    """A number from 0 up to 1 that depends on the seed and the id only."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def plan_mix(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """For each row of ``docs`` how often the mix takes it.

    Columns: doc_id, source, size, source_size, target, copies, taken.  Null text
    has size 0; null is a source of its own; repeated rows share their draw, as
    it depends on the id only.  No rows give no rows.
    """
    # only an id, a source and a count are kept of each text, so it is read once
    slim = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words().alias("size")))
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = small(cut(targets(sizes, **options).withColumnRenamed("source", "of")))
    out = slim.join(rates, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (chance(seed=seed) < rate - F.floor(rate)).cast("long")
    return out.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """``docs``, each row as often as ``plan_mix`` takes it, with its number in ``copy``.

    The draw needs the id and the source's rate only, so the texts are joined
    with the few rates and not with the plan.
    """
    copy, of, rate = free_name(docs, "copy"), free_name(docs, "mix_source"), free_name(docs, "mix_rate")
    sizes = cut(docs.select(F.col("source").cast("string").alias("source"), words().alias("size")).groupBy("source").agg(F.sum("size").alias("source_size")))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = small(cut(targets(sizes, **options).select(F.col("source").alias(of), share.alias(rate))))
    out = docs.join(rates, docs["source"].cast("string").eqNullSafe(F.col(of)), "left")
    n = F.floor(F.col(rate)) + (chance(seed=seed) < F.col(rate) - F.floor(F.col(rate))).cast("long")
    out = out.withColumn(copy, F.explode(F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))))
    return out.select(*docs.columns, copy)
