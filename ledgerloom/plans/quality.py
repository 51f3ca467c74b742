"""Queries for gates, coverage, accuracy and JSON views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality, reconcile, sets
from ..sources import readers, sinks
from .registry import query, table


@query("""SELECT 'empty_text' AS code, 'blocking' AS severity, count(*) AS n, count(*) > 0 AS blocks FROM documents WHERE text = '' UNION ALL SELECT 'unlabelled', 'warning', count(*), false FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'markers', 'blocking', count(*), count(*) > 0 FROM documents WHERE contains(text, '###')""")
def quality_gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return quality.gate(
        {
            "empty_text": (d.where("text = ''"), "blocking"),
            "unlabelled": (d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti"), "warning"),
            "markers": (d.where(F.contains("text", F.lit("###"))), "blocking"),
        }
    )


@query("""SELECT (SELECT count(*) FROM documents WHERE contains(text, '###')) = 0 AS ok, (SELECT count(*) FROM documents WHERE contains(text, '###')) AS blocking, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS warnings""")
def quality_verdict(spark, sf_dir):
    return quality.passes(quality_gate(spark, sf_dir).where("code <> 'empty_text'"))


@query("SELECT lang, source, count(*) AS expected, count(l.doc_id) AS found, round(count(l.doc_id) / count(*)::DOUBLE, 6) AS rate FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1, 2")
def coverage_rates(spark, sf_dir):
    return quality.coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", ["lang", "source"])


@query("""WITH p AS (SELECT l_orderkey AS k, count(*) AS printed, count(*) FILTER (l_linenumber > 1) + count(*) FILTER (l_orderkey % 5 = 0) AS extracted FROM lineitem GROUP BY 1) SELECT k, printed, extracted, CASE WHEN extracted < printed THEN 'under' WHEN extracted > printed THEN 'over' ELSE 'equal' END AS state FROM p""")
def row_inventory(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber")
    got = rows.where("l_linenumber > 1").union(rows.where("k % 5 = 0"))
    return quality.inventory(rows, got, "k")


@query("""WITH e AS (SELECT doc_id, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic FROM labels), a AS (SELECT doc_id, CAST((NOT contains(text, '###'))::INT AS VARCHAR) AS q, CAST(contains(text, 'idiot')::INT AS VARCHAR) AS t FROM documents WHERE doc_id % 10 <> 0)
SELECT field, count(*) AS expected, count(*) FILTER (e = a) AS correct, count(*) FILTER (a IS NULL) AS missing, round(count(*) FILTER (e = a) / count(*)::DOUBLE, 6) AS accuracy FROM (SELECT 'quality' AS field, quality AS e, q AS a FROM e LEFT JOIN a USING (doc_id) UNION ALL SELECT 'toxic', toxic, t FROM e LEFT JOIN a USING (doc_id)) GROUP BY 1""")
def field_accuracy(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("doc_id % 10 <> 0")
    guess = d.select("doc_id", (~F.contains("text", F.lit("###"))).cast("int").alias("quality"), F.contains("text", F.lit("idiot")).cast("int").alias("toxic"))
    return quality.field_accuracy(table(spark, sf_dir, "labels"), guess, "doc_id", ["quality", "toxic"])


@query("""WITH t AS (SELECT o_orderkey, CASE WHEN n >= 2 AND o_orderkey % 4 <> 0 THEN 'high' WHEN n >= 1 THEN 'medium' ELSE 'review' END AS tier FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
SELECT tier, count(*) AS n, CASE tier WHEN 'high' THEN 0.95 WHEN 'medium' THEN 0.78 ELSE 0.45 END AS score FROM t GROUP BY 1""")
def entity_confidence(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf_dir, "orders").join(counts, "o_orderkey", "left")
    tier = quality.confidence_tier(F.coalesce("n", F.lit(0)), (F.col("o_orderkey") % 4 == 0).cast("int"))
    return rows.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n")).withColumn("score", quality.tier_score(F.col("tier")))


@query("""SELECT event_type, user_id % 4 AS bucket, GROUPING(event_type) * 2 + GROUPING(user_id % 4) AS "grouping", count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 4), ())""")
def validation_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("bucket", F.col("user_id") % 4)
    return quality.occurrence_counts(e, ["event_type", "bucket"], [F.count(F.lit(1)).alias("n")])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'faithful' ELSE 'needs_review' END AS extraction, CASE WHEN o_orderkey % 5 = 0 THEN 'consistent' ELSE 'document_warnings' END AS document FROM orders""")
def two_axis_status(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", quality.two_axis_status(k % 3, k % 5).alias("s")).select("o_orderkey", "s.extraction", "s.document")


@query("""SELECT o_orderkey, list_filter(['a', 'b', 'c'], lambda x: CASE x WHEN 'a' THEN o_orderkey % 2 = 0 WHEN 'b' THEN o_orderkey % 3 = 0 ELSE o_orderkey % 5 = 0 END) AS missing FROM orders""")
def missing_field_names(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumns({"a": F.when(k % 2 == 0, "").otherwise("x"), "b": F.when(k % 3 == 0, F.lit(None)).otherwise("x"), "c": F.when(k % 5 == 0, "").otherwise("x")})
    return rows.select("o_orderkey", reconcile.missing_fields("a", "b", "c").alias("missing"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def payload_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT event_id, map_keys(m) AS keys FROM (SELECT event_id, map_from_entries(list_filter([{'k': 'type', 'v': event_type}, {'k': 'user', 'v': CASE WHEN user_id % 2 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END}], lambda x: x.v <> '')) AS m FROM events)""")
def drop_empties(spark, sf_dir):
    m = F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.when(F.col("user_id") % 2 == 0, "").otherwise(F.col("user_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", F.map_keys(sinks.without_empty(m)).alias("keys"))


@query("SELECT n_regionkey, count(*) AS n, min(n_name) AS first FROM nation GROUP BY 1")
def json_assembly(spark, sf_dir):
    """Rows into one JSON text for each region, and what a reader gets back."""
    views = sinks.json_view(table(spark, sf_dir, "nation"), "n_regionkey", ["n_name"])
    back = views.withColumn("r", F.from_json("json", "struct<rows:array<struct<n_nationkey:int,n_name:string>>>"))
    return back.select("n_regionkey", F.size("r.rows").cast("long").alias("n"), F.element_at("r.rows", 1)["n_name"].alias("first"))


@query("""SELECT conv_id, list_sort(list_filter(['assistant', 'system', 'tool', 'user'], lambda x: NOT list_contains(roles, x))) AS missing, list_filter(['system'], lambda x: list_contains(roles, x)) AS forbidden FROM (SELECT conv_id, list(DISTINCT role) AS roles FROM conversations GROUP BY 1)""")
def output_contract(spark, sf_dir):
    have = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("have"))
    return have.select("conv_id", sets.missing_keys(F.col("have"), ["assistant", "system", "tool", "user"], ["system"]).alias("m")).select("conv_id", "m.missing", "m.forbidden")


@query("SELECT conv_id, turn, role FROM conversations WHERE turn BETWEEN 1 AND 3")
def page_range_scan(spark, sf_dir):
    return readers.page_range(table(spark, sf_dir, "conversations").withColumnRenamed("turn", "page"), 1, 3).select("conv_id", F.col("page").alias("turn"), "role")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id % 7 = 0 AND turn IN (0, 2)")
def page_subset_scan(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "role")
    wanted = pages.where("doc_id % 7 = 0 and page in (0, 2)")
    return readers.page_subset(pages, wanted).select(F.col("doc_id").alias("conv_id"), F.col("page").alias("turn"), "role")


@query("SELECT count(DISTINCT (o_custkey, o_orderstatus)) AS n FROM orders")
def content_keys(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(readers.content_key("o_orderstatus", "o_custkey").alias("k")).agg(F.count_distinct("k").alias("n"))
