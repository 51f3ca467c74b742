"""Connected components in rounds of large and small stars.

Every round is two joins on the edges left; nothing is gathered in one place.
A node with very many neighbours is spread over ``SPREAD`` parts: the least
neighbour is found for each part, then over the parts, and is handed back to
just those parts that exist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SPREAD = 64


def part_of(column):
    return F.pmod(F.xxhash64(column), F.lit(SPREAD)).cast("int")


def _with_least(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) with the least v of each u as m."""
    edges = edges.withColumn("p", part_of("v"))
    least = edges.groupBy("u", "p").agg(F.min("v").alias("m")).groupBy("u").agg(F.min("m").alias("m"), F.collect_set("p").alias("ps"))
    return edges.join(least.select("u", F.explode("ps").alias("p"), "m"), ["u", "p"]).drop("p")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and label, the least node that it is connected with, for every node of ``edges`` (a, b).

    Nodes may be of any orderable type; loops and repeated edges do not matter,
    edges with a null end are left out.  No edges give no rows.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = cut(e.distinct())
    last = None
    for _ in range(rounds):
        state = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if state == last or not state.n:
            break
        last = state
        both = e.union(e.select("v", "u"))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        small = _with_least(large)
        e = cut(small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select("v", "m")).distinct())
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select("v", "v").distinct())
