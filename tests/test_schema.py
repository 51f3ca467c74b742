"""What tables lack, section headers, and all places of a code."""

from ledgerloom.operators import recovery, schema
from ledgerloom.plans import registry


def test_gaps_of_nulls_repeats_and_nothing(spark):
    rows = [(1, None, ["a", "b"]), (2, ["B ", "b", ""], ["a", None, "b", "b", "c"]), (3, ["a"], None), (4, ["a"], [])]
    got = schema.gaps(spark.createDataFrame(rows, "table_id int, available array<string>, expected array<string>")).collect()
    assert sorted((r.table_id, r.missing, r.left, r.right) for r in got) == sorted([(1, "a", None, None), (1, "b", None, None), (2, "a", None, "b"), (2, "c", "b", None)], key=str)


def test_kinds(spark):
    words = {"93391": {"code", "number", "money", "text"}, "CP-120": {"code", "text"}, "Próprio": {"bank", "text"}, "m2": {"unit", "text"}, "R$ 1,50": {"money", "text"}, "de": {"text"}, "": set()}
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", schema.kinds(schema.F.col("w")).alias("k"))
    assert {r.w: set(r.k) for r in df.collect()} == words


def test_merge_plan_without_samples_goes_by_place(spark):
    t = spark.createDataFrame([(1, ["banco"], ["codigo", "banco"]), (2, ["codigo", "banco"], ["codigo", "banco"])], "table_id int, available array<string>, expected array<string>")
    assert [tuple(r) for r in schema.merge_plan(t).collect()] == [(1, "codigo", "banco", "place", 0.68, 0)]
    assert schema.merge_plan(t.limit(0)).count() == 0


def test_section_map_takes_the_first_line(spark):
    lines = [("d", 2, 1, "C Material", 1.0), ("d", 1, 9, "Momento de transporte", 2.0), ("d", 1, 4, "materiais diversos", 3.0), ("d", 1, 5, None, 4.0), ("d", 1, 6, "Abraço", 5.0)]
    df = spark.createDataFrame([(a, b, c, t, x, x, x, x) for a, b, c, t, x in lines], "doc string, page int, line_no int, text string, x0 double, x1 double, y0 double, y1 double")
    assert sorted((r.section, r.page, r.x0) for r in schema.section_map(df).collect()) == [("C", 2, 1.0), ("F", 1, 2.0)]


def test_all_places_of_a_code(spark):
    text = "93391/001 SINAPI x 93391 aqui" + " y" * 40 + " 93391 SINAPI z 93391 SINAPI"
    pages = spark.createDataFrame([(1, text), (2, "93391 só 93391"), (3, "193391 e 93391/001"), (4, None)], "page int, text string")
    ids = spark.createDataFrame([("93391", "SINAPI")], "code string, bank string")
    got = sorted((r.page, r["at"], r.match, r.confidence) for r in recovery.occurrences(pages, ids).collect())
    second = text.index("93391 SINAPI") + 1
    assert got == [(1, second, "code_bank", 0.96), (1, text.rindex("93391") + 1, "code_bank", 0.96), (2, 1, "code_only", 0.65), (2, 10, "code_only", 0.65)]


def test_nothing_that_comes_of_arrays_is_broadcast(spark, sf_dir):
    for name in ("schema_anomalies", "missing_column_plan"):
        assert "BroadcastHashJoin" not in registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
