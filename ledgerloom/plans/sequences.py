"""Queries on ordered rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequence, sets
from ..streaming import events as stream
from .registry import query, table


@query("""WITH b AS (SELECT conv_id, turn, role, lag(role) OVER w AS pr, lag(turn) OVER w AS pt FROM (SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN 'a' ELSE 'b' END AS role FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, role, sum(CASE WHEN pr IS NOT NULL AND pr = role AND turn - pt <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM b""")
def page_stitch(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.length("text") % 3 == 0, "a").otherwise("b").alias("role"))
    return sequence.stitch(rows, ["conv_id"], "turn", ["role"])


@query("SELECT conv_id, turn, lag(role) OVER w AS prev_role, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def neighbor_context(spark, sf_dir):
    return sequence.neighbours(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role").select("conv_id", "turn", "prev_role", "next_role")


@query("SELECT conv_id, turn, max((length(text) % 10 = 0)::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS near FROM conversations")
def page_buffer(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("flag", F.length("text") % 10 == 0)
    return sequence.dilate(rows, ["conv_id"], "turn", "flag", 1).select("conv_id", "turn", "near")


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, count(*) OVER (PARTITION BY user_id) - 1 AS last FROM events)
SELECT user_id, event_id FROM r WHERE last < 5 OR list_contains(list_transform(range(0, 5), lambda i: round_even(last * i / 4.0::DOUBLE, 0)::BIGINT), place)""")
def systematic_sample(spark, sf_dir):
    return sequence.systematic_sample(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", 5)


@query("""WITH g AS (SELECT user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events), k AS (SELECT user_id, gap, row_number() OVER (PARTITION BY user_id ORDER BY gap) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS n FROM g WHERE gap > 0)
SELECT user_id, gap AS median_gap, n, round(gap * 1.45, 4) AS continuation_max_gap, round(gap * 1.75, 4) AS item_gap_min FROM k WHERE place = n // 2""")
def gap_profile(spark, sf_dir):
    return sequence.gap_profile(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id")


@query("""WITH b AS (SELECT conv_id, turn, text, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS row_no FROM conversations)
SELECT conv_id, row_no::BIGINT AS row_no, md5(string_agg(text, ' ' ORDER BY turn)) AS joined, count(*) AS n_parts FROM b GROUP BY 1, 2""")
def continuation_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = sequence.continuations(rows, ["conv_id"], ["turn"], F.col("role") == "user", "text")
    return out.select("conv_id", "row_no", F.md5("text").alias("joined"), F.col("n_parts").cast("long").alias("n_parts"))


_LINES = "SELECT o_custkey AS doc, o_orderkey AS ord, CASE WHEN o_orderkey % 3 = 0 THEN 'COMPOSICAO' ELSE 'INSUMO' END AS kind, CAST(o_orderkey % 4 AS VARCHAR) AS key FROM orders"


@query(f"""WITH l AS ({_LINES}), p AS (SELECT *, last_value(CASE WHEN kind = 'COMPOSICAO' THEN key END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l),
b AS (SELECT *, (kind = 'COMPOSICAO' AND key IS DISTINCT FROM before) AS s FROM p), n AS (SELECT *, sum(s::INT) OVER (PARTITION BY doc ORDER BY ord ROWS UNBOUNDED PRECEDING) AS block FROM b), h AS (SELECT doc, key AS block_key, max(block) AS block FROM n WHERE s GROUP BY 1, 2)
SELECT doc, ord, block::BIGINT AS block, block_key FROM n LEFT JOIN h USING (doc, block) WHERE block = 0 OR block_key IS NOT NULL""")
def block_segmentation(spark, sf_dir):
    n = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), n.alias("ord"), F.when(n % 3 == 0, "COMPOSICAO").otherwise("INSUMO").alias("kind"), (n % 4).cast("string").alias("key"))
    return sequence.blocks(rows, "doc", ["ord"]).select("doc", "ord", "block", "block_key")


def words(spark, sf_dir):
    """Parts as words on pages: about seven lines a page, slightly uneven."""
    k = F.col("p_partkey")
    y = (k % 7) * 12.0 + (k % 3) * 0.6
    return table(spark, sf_dir, "part").select(F.floor(k / 60).cast("int").alias("page"), (k % 60 * 10.0).alias("x0"), y.alias("y0"), (k % 60 * 10.0 + 8).alias("x1"), (y + 8).alias("y1"), F.concat(F.lit("w"), k.cast("string")).alias("text"))


_WORDS = "SELECT CAST(p_partkey // 60 AS INT) AS page, p_partkey % 60 * 10.0::DOUBLE AS x0, (p_partkey % 7) * 12.0::DOUBLE + (p_partkey % 3) * 0.6::DOUBLE AS y0, 'w' || p_partkey AS text FROM part"


@query(f"SELECT page, CAST(round(y0 / 12 - 0.04) AS INT) AS line_no, string_agg(text, ' ' ORDER BY x0) AS text FROM ({_WORDS}) GROUP BY 1, 2")
def line_clusters(spark, sf_dir):
    return sequence.line_clusters(words(spark, sf_dir), ["page"]).select("page", "line_no", "text")


@query(f"SELECT page, CAST(round(y0 / 12 - 0.04) AS INT) AS line_no, count(*) AS n FROM ({_WORDS}) GROUP BY 1, 2")
def line_clusters_first_fit(spark, sf_dir):
    out = sequence.line_clusters(words(spark, sf_dir), ["page"], anchor="top", tolerance=3.5, rule="first_fit")
    return out.select("page", "line_no", F.size(F.split("text", " ")).cast("long").alias("n"))


@query(f"SELECT page, CAST(round(y0 / 12 - 0.04) AS BIGINT) + 1 AS line_no, count(*) AS n FROM ({_WORDS}) GROUP BY 1, 2")
def line_clusters_by_gap(spark, sf_dir):
    return sequence.line_clusters_by_gap(words(spark, sf_dir), ["page"], "y0", 3.0).groupBy("page", "line_no").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents) SELECT doc_id, count(*) FILTER (regexp_matches(s, '^\s*\d+(\.\d+)+\s+\S+')) AS items, count(*) FILTER (regexp_matches(s, '^\s*(total|subtotal|valor)\b', 'i')) AS totals, count(*) AS n FROM l GROUP BY 1""")
def line_barriers(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    out = sequence.line_profile(rows)
    return out.groupBy("doc_id").agg(F.count_if(F.col("barrier") == "budget_item_boundary").alias("items"), F.count_if(F.col("barrier") == "total_boundary").alias("totals"), F.count(F.lit(1)).alias("n"))


@query("SELECT min(doc_id) AS doc_id, md5(text) AS h, count(*) > 0 AS kept FROM documents GROUP BY text")
def stable_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    return sets.first_by(rows, ["h"], ["doc_id"]).select("doc_id", "h", F.lit(True).alias("kept"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity, l_extendedprice, l_suppkey) AS rn FROM lineitem) WHERE rn = 1""")
def dedup_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_suppkey")
    return sets.first_by(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_quantity", "l_extendedprice", "l_suppkey"]).drop("l_suppkey")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def aux_except(spark, sf_dir):
    return sets.except_by(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("""WITH u AS (SELECT md5(text) AS h, item_id AS id, 0 AS part FROM benchmark UNION ALL SELECT md5(text), doc_id, 1 FROM documents) SELECT h, id, part FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY part, id) AS rn FROM u) WHERE rn = 1""")
def union_distinct_first(spark, sf_dir):
    a = table(spark, sf_dir, "benchmark").select(F.md5("text").alias("h"), F.col("item_id").alias("id"))
    b = table(spark, sf_dir, "documents").select(F.md5("text").alias("h"), F.col("doc_id").alias("id"))
    return sets.union_first([a, b], ["h"], ["id"])


@query("""SELECT coalesce(a.c_nationkey, b.s_nationkey) AS nation, coalesce(b.bal, a.bal) AS bal, a.seg AS item, CASE WHEN a.c_nationkey IS NOT NULL AND b.s_nationkey IS NOT NULL THEN 'replaced' WHEN b.s_nationkey IS NOT NULL THEN 'inserted' ELSE 'kept' END AS origin
FROM (SELECT c_nationkey, max(c_acctbal) AS bal, min(c_mktsegment) AS seg FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey + 7 AS s_nationkey, max(s_acctbal) AS bal FROM supplier GROUP BY 1) b ON a.c_nationkey = b.s_nationkey""")
def upsert_precedence(spark, sf_dir):
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.max("c_acctbal").alias("bal"), F.min("c_mktsegment").alias("item"))
    b = table(spark, sf_dir, "supplier").groupBy((F.col("s_nationkey") + 7).alias("nation")).agg(F.max("s_acctbal").alias("bal"), F.lit(None).cast("string").alias("item"))
    return sets.upsert(a, b, "nation", ["bal"], ["item"])


@query("""SELECT o_orderkey, 'o_orderstatus' AS field, o_orderstatus AS a, CASE WHEN o_orderkey % 5 = 1 THEN 'X' END AS b, CASE WHEN o_orderkey % 5 = 0 THEN 'only_left' ELSE 'changed' END AS kind FROM orders WHERE o_orderkey % 5 < 2""")
def run_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    other = o.where("o_orderkey % 5 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 1, "X").otherwise(F.col("o_orderstatus")))
    return sets.field_diff(o, other, "o_orderkey", ["o_orderstatus"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'auxiliares_globais' ELSE 'principais' END AS collection FROM orders""")
def collection_split(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", sets.collection_of(F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise("1.1")).alias("collection"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.tumbling(rows).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""SELECT p_brand, greatest(2.0, least(4.2, median(p_size::DOUBLE) * 0.45)) AS tolerance FROM part GROUP BY 1""")
def adaptive_tolerance(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(sequence.adaptive_tolerance(F.col("p_size")).alias("tolerance"))
