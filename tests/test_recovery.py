"""Operators that find, clean and judge text, and the whole run on a printed page."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import reconcile
from ledgerloom.operators import recovery as V
from ledgerloom.plans import lifecycle

PAGE = """ 4.5.2 CódigoBanco Descrição Tipo Und Quant. Valor Unit Total
Composição 93391 SINAPI REVESTIMENTO CERÂMICO PARA PISO m² 1,0000000 69,88 69,88
Composição Auxiliar 88256 SINAPI AZULEJISTA COM ENCARGOS COMPLEMENTARES H 0,2411000 31,60 7,61
Composição Auxiliar 88316 SINAPI SERVENTE COM ENCARGOS COMPLEMENTARES H 0,1290000 24,36 3,14
Insumo 00001381 SINAPI ARGAMASSA COLANTE AC I PARA CERAMICAS KG 9,1325000 1,08 9,86
Insumo 00034357 SINAPI REJUNTE CIMENTICIO, QUALQUER COR KG 0,2410000 6,34 1,52
Insumo 00001297 SINAPI PISO EM CERAMICA ESMALTADA m² 1,0571000 45,18 47,75
MO sem LS 3,70 LS => 4,22"""


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_whole_run(spark):
    pages = spark.createDataFrame([("d", 24, PAGE)], "doc_id string, page int, text string")
    out = lifecycle.run(lifecycle.STAGES, {"pages": pages})
    assert out.ok and set(out.seconds) == {s.name for s in lifecycle.STAGES}
    math = out.relations["math"].first()
    assert (math.block_key, math.status, math.missing_totals) == ("93391|SINAPI", "ok", 0)
    assert out.relations["verdict"].first().ok
    row = out.relations["rows"].where("codigo = '00001297'").first()
    assert (row.und, row.quant, row.valor_unit, row.total) == ("m²", "1,0571000", "45,18", "47,75")


def test_failed_stage_is_an_issue(spark):
    def broken(_):
        raise ValueError("no")

    out = lifecycle.run([lifecycle.Stage("a", broken), lifecycle.Stage("b", broken, False)], {})
    assert not out.ok and [s for _, s, _ in out.issues] == ["blocking", "warning"]


def test_markers_and_k():
    assert V.marker_variants(["Mão  de Obra"]) == ["Mão de Obra", "MÃO DE OBRA", "Mao de Obra", "MAO DE OBRA", "MãodeObra"]
    assert [V.adaptive_k(*x) for x in ((10, 10), (50, 1), (1, 150), (200, 1))] == [48, 12, 10, 8]


def test_noise_and_prefix(spark):
    assert value(spark, V.without_noise(F.lit("TUBO PVC. AF_06/2022 Livro SINAPI Parâmetros"))) == "TUBO PVC. AF_06/2022"
    r = value(spark, V.split_prefix(F.lit("12345/001 SINAPI TUBO DE PVC")))
    assert (r.codigo, r.banco, r.descricao, r.changed) == ("12345/001", "SINAPI", "TUBO DE PVC", True)
    assert not value(spark, V.split_prefix(F.lit("TUBO DE PVC"))).changed
    s = value(spark, V.split_tail(F.lit("TUBO DE PVC M 1,00 2,00 2,00")))
    assert s.descricao == "TUBO DE PVC" and s.tail.total == "2,00"


@pytest.mark.parametrize(("field", "v", "ok"), [("und", "kg", True), ("und", "xyz", False), ("quant", "1,5", True), ("quant", "0", False), ("total", "10", False), ("total", "10,00", True), ("descricao", "LS => 4", False), ("codigo", "", False)])
def test_validators(spark, field, v, ok):
    assert value(spark, V.validate(F.lit(field), F.lit(v))).ok is ok


def test_ownership_and_reverse_repair(spark):
    near = F.array(F.lit("LINHA DE CIMA AQUI"), F.lit("LINHA DE BAIXO AQUI"))
    mixed = F.lit("LINHA DE CIMA AQUI AQUISIÇÃO DE ASFALTO DILUIDO CM-30 LINHA DE BAIXO AQUI")
    o = value(spark, V.ownership(mixed, F.lit(""), F.lit(""), near))
    assert o.hits == 2 and not o.safe and o.delta == -3.5
    assert value(spark, V.reverse_repair(mixed, F.lit("AQUISIÇÃO DE ASFALTO DILUIDO CM-30"), near))


def test_foreign_fragments(spark):
    rows = spark.createDataFrame([("a", "x y um dois tres quatro"), ("b", "um dois tres quatro")], "row_id string, text string")
    frag = spark.createDataFrame([("b", "um dois tres", 0.95), ("c", "x y", 0.99), ("d", "um dois tres", 0.5)], "owner_id string, fragment string, confidence double")
    assert [(r.row_id, r.owner_id) for r in V.foreign_fragments(rows, frag).collect()] == [("a", "b")]


def test_chain_conflicts(spark):
    rows = spark.createDataFrame([("k", "TUBO", "M", 10.0, "TUBO DE PVC", "UN", 20.0, 1)], "key string, b_descricao string, b_und string, b_price double, c_descricao string, c_und string, c_price double, missing_auxiliaries int")
    assert {r.field: r.severity for r in V.chain_conflicts(rows).collect()} == {"descricao": "confirmed", "und": "strong", "unit_price": "warning", "auxiliary_chain": "info"}


def test_occurrences_and_printed_tokens(spark):
    pages = spark.createDataFrame([(1, "89446 SINAPI TUBO PVC m 1,0000000 14,27 14,27"), (2, "ver 89446 na lista"), (3, "nada")], "page int, text string")
    ids = spark.createDataFrame([("89446", "SINAPI")], "code string, bank string")
    got = {r.page: (r.match, r.confidence) for r in V.occurrences(pages, ids).collect()}
    assert got == {1: ("code_bank", 0.96), 2: ("code_only", 0.65)}
    w = F.lit("TUBO PVC m 1,0000000 14,27 14,27")
    assert value(spark, V.printed_token(w, F.lit("1"), "quant")) == "1,0000000"
    assert value(spark, V.printed_token(w, F.lit("2"), "quant")) == "2"
    assert value(spark, V.printed_token(w, F.lit(""), "und")) == "m"


def test_split_join_and_fuse(spark):
    assert value(spark, V.split_rows(F.lit("Insumo 1 A Insumo 2 B Composição Auxiliar 3 C"))) == ["Insumo 1 A", "Insumo 2 B", "Composição Auxiliar 3 C"]
    lines = spark.createDataFrame([(1, 0, "Insumo 1"), (1, 1, "TUBO"), (1, 2, "UN 1,00")], "doc int, ord int, text string")
    joined = V.first_whole(lines, ["doc"], "ord", "text", lambda c: c.rlike(r"^Insumo.*\d,\d{2}$")).orderBy("ord").first()
    assert joined.joined == "Insumo 1 TUBO UN 1,00"
    rows = spark.createDataFrame([(1, 10.0, "1,00 2,00"), (1, 16.0, "89446 TUBO"), (1, 22.0, "SOLDAVEL"), (1, 60.0, "longe")], "page int, y double, text string")
    assert [r.fused for r in V.fuse_baselines(rows, ["page"], "y", "text").collect()] == ["89446 TUBO SOLDAVEL 1,00 2,00"]


def test_sections_of_hourly_cost(spark):
    text = ["Composição 1107892 SICRO3 Concreto", "A - Equipamentos", "Equipamento SICRO3 E9010", "C - Material", "Insumo SICRO3 M0030", "Custo total"]
    got = V.section_state(spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "doc int, ord int, t string"), "doc", "ord", "t").orderBy("ord").collect()
    assert [r.section for r in got] == ["", "A", "A", "C", "C", "C"] and {r.composition for r in got} == {"1107892"}
    assert [r.kind for r in got] == ["principal", "header", "row", "header", "row", "summary"]


def test_best_closing_combination(spark):
    rows = spark.createDataFrame([(1, "q", 2.0, 0.5), (1, "q", 3.0, 0.6), (1, "price", 4.0, 0.5), (1, "cost", 8.0, 0.5)], "row_id int, field string, value double, score double")
    r = V.close_section_rows(rows).first()
    assert (r.q, r.closes) == (2.0, True)


def test_page_plan(spark):
    pages = spark.createDataFrame([(1, 1, "capa"), (1, 2, "nada 1,00 2,00 3,00"), (1, 3, "Código Quant"), (1, 9, "SICRO")], "doc int, page int, text string")
    assert [r.plan for r in V.page_plan(pages, ["doc"], "page", "text").orderBy("page").collect()] == ["skip", "text", "table", "sicro"]


def test_reference_compare(spark):
    v = lambda *x: value(spark, V.compare_reference(*[F.lit(i).cast("double") for i in x]))
    assert [v(10, 10, 2, 12, 24), v(10, 11, 2, 12, 24), v(10, None, None, None, None)] == ["ok", "divergente", "sem_referencia_no_sintetico"]


def test_closure_pattern_targets(spark):
    assert value(spark, V.closure_class(F.lit("closed_100"), F.lit(False), F.lit("ok"))) == "closed_unsupported"
    codes = spark.createDataFrame([("E9010",), ("x",)], "c string")
    assert [r.family for r in V.first_pattern(codes, [("equipamento", r"^E\d{4}$")], "c").collect()] == ["equipamento", "unknown"]
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "id int, missing array<string>")
    assert V.targets(rows, "id", "missing", 1).count() == 1


def test_a_quantity_of_zero_is_refused_without_a_reason(spark):
    rows = spark.createDataFrame([("quant", "0,00"), ("quant", "-1"), ("quant", "1"), ("quant", "x"), ("total", "0,00")], "f string, v string")
    got = [(r.v.ok, r.v.reason) for r in rows.select(V.validate(F.col("f"), F.col("v")).alias("v")).collect()]
    assert got == [(False, ""), (False, ""), (True, ""), (False, "quantity_parse_failed"), (True, "")]


def test_the_whole_run_parses_every_line_once(spark):
    pages = spark.createDataFrame([("d", 24, PAGE)], "doc_id string, page int, text string")
    plan = lifecycle.run(lifecycle.STAGES, {"pages": pages}).relations["math"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate posexplode") == 1 and "Join" not in plan


def test_blocks_in_one_pass_are_as_in_two(spark):
    rows = [("a", "P", 10.0), ("a", "r", 4.0), ("a", "r", 6.0), ("b", "P", 3.0), ("b", "P", 5.0), ("b", "r", None), ("c", "P", None), ("c", "r", 1.0), ("d", "P", 2.0), ("e", "r", 2.0)]
    df = spark.createDataFrame(rows, "k string, kind string, amount double")
    heads = df.where("kind = 'P'").groupBy("k").agg(F.max("amount").alias("declared"))
    two = reconcile.component_status(heads, df.where("kind <> 'P'"), "k", "declared", "amount")
    one = reconcile.block_status(df, ["k"], F.col("kind") == "P", "amount").select(two.columns)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
