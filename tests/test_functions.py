"""Functions and operators on the domain's golden cases."""

import difflib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import numeric as N
from ledgerloom.functions import rows as R
from ledgerloom.functions import similarity as S
from ledgerloom.functions import text as T
from ledgerloom.operators import evidence, linkage, quality, reconcile, repair, sequence, sets, sicro, structure
from ledgerloom.sources import readers, sinks
from ledgerloom.streaming import events


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("token", "strict", "dec", "lenient"),
    [("1.234,56", 1234.56, 1234.56, 1234.56), ("1.234", 1234.0, 1.234, 1234.0), ("12.5", None, 12.5, 12.5), ("R$ 7,10", 7.1, 7.1, None), ("12345/001", None, None, None), ("", None, None, None), (None, None, None, None), ("-3,5", -3.5, -3.5, -3.5)],
)
def test_dialects(spark, token, strict, dec, lenient):
    t = F.lit(token).cast("string")
    assert value(spark, N.parse_strict(t)) == strict
    assert value(spark, N.parse_math(t)) == dec
    assert value(spark, N.parse_lenient(t)) == lenient


def test_format_and_public_text(spark):
    assert value(spark, N.format_ptbr(F.lit(1234.5))) == "1.234,50"
    assert value(spark, N.public_text(F.lit(0.2411))) == "0,2411"
    assert value(spark, N.public_text(F.lit(12.0))) == "12"
    assert value(spark, N.printed_scale(F.lit("0,8464600"))) == 7


def test_expected_values_are_never_written(spark):
    r = value(spark, N.solve_triplet(F.lit("1,0000000"), F.lit("14,27"), F.lit("")))
    assert (r.field, r.expected, r.public_write_allowed) == ("total", "14,27", False)
    assert value(spark, N.solve_triplet(F.lit("1"), F.lit(""), F.lit(""))) is None


def test_tail_of_a_row(spark):
    line = "Insumo 00001297 SINAPI PISO EM CERAMICA ESMALTADA, COMERCIAL (PADRAO POPULAR), PEI MAIOR OU IGUAL Material m² 1,0571000 45,18 47,75 A 3, FORMATO MENOR OU IGUAL A 2025 CM2"
    t = value(spark, R.numeric_tail(F.lit(line)))
    assert (t.und, t.quant, t.valor_unit, t.total) == ("m²", "1,0571000", "45,18", "47,75")
    two = "Insumo 1 SINAPI X UN 1,00 2,00 2,00 Y KG 3,00 4,00 12,00"
    assert value(spark, R.expected_tail(F.lit(two), F.lit("2,00"))).und == "UN"
    assert value(spark, R.tail_status(F.lit(two))) == "ambiguous"


def test_parse_row(spark):
    r = value(spark, R.parse_row(F.lit("Composição 89446 SINAPI TUBO PVC ESGOTO m 1,0000000 14,27 14,27")))
    assert (r.kind, r.codigo, r.banco, r.descricao, r.und, r.total) == ("Composição", "89446", "SINAPI", "TUBO PVC ESGOTO", "m", "14,27")


def test_fill_writes_only_printed_tokens(spark):
    rows = spark.createDataFrame([("UN", "1,0000000", "14,27", "", "no tail here"), ("", "", "", "", "x UN 1,0 5,47 5,47")], "und string, quant string, valor_unit string, total string, line string")
    got = repair.fill_tail(rows, "line").orderBy("line").collect()
    assert got[0].total in ("", None) and got[1].total == "5,47"


def test_subtotal_moves_to_its_owner(spark):
    groups = spark.createDataFrame([("1", "1.1", 1, 52365.69, 3804.96), ("1", "1.2", 2, None, 48560.73)], "parent string, child string, ord int, child_total double, child_sum double")
    parents = spark.createDataFrame([("1", None, 52365.69)], "parent string, parent_total double, parent_sum double")
    r = reconcile.move_subtotals(groups, parents, "parent").collect()
    assert [(x.from_child, x.moved_total) for x in r] == [("1.1", 52365.69)]


def test_group_with_one_leaf(spark):
    nodes = spark.createDataFrame([(1, "1", False, None, 142.70), (1, "1.1", True, 142.70, None)], "doc_id int, item string, is_leaf boolean, amount double, declared double")
    assert reconcile.leaf_rollup(nodes).first().status == "ok"


def test_relation_contract(spark):
    allowed = lambda r, f: value(spark, evidence.relation_allows(F.lit(r), F.lit(f)))
    assert allowed("budget_to_main_composition", "und") and allowed("global_to_contextual_auxiliary", "valor_unit")
    assert not allowed("budget_to_main_composition", "quant") and not allowed("other", "und")


def test_occurrence_consensus(spark):
    one = spark.createDataFrame([("r", "und", "m", 3, 0.83)], "row_id string, field string, value string, page int, confidence double")
    two = spark.createDataFrame([("r", "und", "m", 3, 0.84), ("r", "und", "m", 29, 0.86)], one.schema)
    assert not evidence.occurrence_consensus(one).first().accepted
    assert evidence.occurrence_consensus(two).first().accepted


def test_grade(spark):
    g = value(spark, evidence.grade(F.lit("1"), F.lit("deep_area_sweep"), F.lit(True)))
    assert g == "physical_pdf_evidence_math_confirmed" and value(spark, evidence.is_supported(F.lit(g)))


def test_header_map(spark):
    heads = ["CÓDIGO", "BANCO", "DESCRIÇÃO", "Tipo", "Und", "Quant.", "Valor Unit", "Total"]
    cells = spark.createDataFrame([("t", i, h) for i, h in enumerate(heads)], "table_id string, col_index int, text string")
    got = {r.canonical: r.col_index for r in structure.header_map(cells).collect()}
    assert {k: got[k] for k in ("und", "quant", "valor_unit", "total")} == {"und": 4, "quant": 5, "valor_unit": 6, "total": 7}


def test_misread_header(spark):
    cells = spark.createDataFrame([("t", 0, "Descricaao"), ("t", 1, "Quantidadee"), ("t", 2, "Tipo")], "table_id string, col_index int, text string")
    assert {r.canonical: r.col_index for r in structure.header_map(cells).collect()} == {"descricao": 0, "quant": 1}
    assert structure.header_map(cells, min_similarity=None).count() == 0


def test_continuation_down_and_up(spark):
    lines = spark.createDataFrame([(1, 50.0, "SERVENTE JUNIOR COM", ""), (1, 62.0, "ENCARGOS COMPLEMENTARES", ""), (1, 74.0, "1.2 OUTRO", "budget_item_boundary")], "page int, y double, text string, barrier string")
    anchors = spark.createDataFrame([(1, 7, 50.0)], "page int, anchor_id long, y double")
    assert sequence.bounded_scan(lines, ["page"], anchors).first().text == "ENCARGOS COMPLEMENTARES"
    up = spark.createDataFrame([(1, 38.0, "ESCAVAÇÃO", ""), (1, 10.0, "longe", "")], lines.schema)
    assert sequence.bounded_scan(up, ["page"], anchors, up=True).first().text == "ESCAVAÇÃO"


def test_line_barriers(spark):
    b = lambda s: value(spark, sequence.barrier(F.lit(s)))
    assert b("1.1.1 74209/001 PLACA") == "budget_item_boundary"
    assert b("10,00 20,00 30,00") == "financial_values_boundary"
    assert b("MANUAL DE VALA") == ""


def test_truncated_text_and_unit_are_filled_from_the_other_table(spark):
    budget = spark.createDataFrame([("k", "TUBO DE PVC PARA ESGOTO PREDIAL", "M")], "key string, descricao string, und string")
    comp = spark.createDataFrame([("k", "TUBO DE PVC", "")], budget.schema)
    r = linkage.enrich(budget, comp, "key").first()
    assert r.composition_descricao == "TUBO DE PVC PARA ESGOTO PREDIAL" and r.composition_und == "M"


def test_diff_scan_finds_the_missing_occurrence(spark):
    known = spark.createDataFrame([("12345", "SINAPI", 1, "UN 1,0000000 10,00 10,00", "TUBO", "p")], "code string, bank string, page int, tail string, sig string, path string")
    seen = spark.createDataFrame([(1, "12345", "SINAPI", 1, "UN 1,0000000 10,00 10,00", "TUBO"), (2, "12345", "SINAPI", 2, "UN 2,0000000 10,00 20,00", "OUTRO")], "line_id int, code string, bank string, page int, tail string, sig string")
    got = {r.line_id: r.reason for r in linkage.occurrence_match(seen, known).collect()}
    assert got == {1: "matched_by_occurrence_context", 2: "same_code_but_no_occurrence_context_match"}


@pytest.mark.parametrize(("a", "b"), [("SICRO3", "M0030"), ("E9010", "SICRO3")])
def test_code_and_bank_in_either_order(spark, a, b):
    r = value(spark, sicro.code_and_bank(F.lit(a), F.lit(b)))
    assert r.banco == "SICRO" and r.codigo in ("M0030", "E9010")


@pytest.mark.parametrize(
    ("section", "line", "want"),
    [
        ("C", "Insumo SICRO3 M0030 Aditivo plastificante e retardador de pega 0,8464600 kg 9,3695 7,9309", ("M0030", "0,8464600", "9,3695", "7,9309")),
        ("D", "Atividade Auxiliar SICRO3 1109669 Argamassa de cimento e areia 1:3 0,0001000 m³ 644,2900 0,0644", ("1109669", "0,0001000", "644,2900", "0,0644")),
        ("E", "Tempo Fixo SICRO3 M0030 Carga, manobra e descarga de materiais 5914655 0,0008500 t 33,3400 0,0283", ("5914655", "0,0008500", "33,3400", "0,0283")),
    ],
)
def test_section_lines_keep_their_tokens(spark, section, line, want):
    r = value(spark, sicro.parse_section_line(section, F.lit(line)))
    assert (r.codigo, r.quantidade, r.preco_unitario, r.custo) == want and r.banco == "SICRO"


def test_permuted_numbers_are_put_right(spark):
    r = value(spark, sicro.repaired(F.array(F.lit(99.0), F.lit(2.0), F.lit(3.5), F.lit(7.0))))
    assert sorted((r.q, r.price)) == [2.0, 3.5] and r.cost == 7.0


def test_accuracy_of_equal_trees_is_one(spark):
    rows = spark.createDataFrame([("1", "UN", "2,00")], "item string, und string, total string")
    assert {r.accuracy for r in quality.field_accuracy(rows, rows, "item", ["und", "total"]).collect()} == {1.0}


def test_public_projection_has_no_float(spark):
    out = sinks.public(spark.createDataFrame([("a", 1.5, 2.0)], "k string, x double, calc_total double"))
    assert dict(out.dtypes) == {"k": "string", "x": "string"} and out.first().x == "1,5"


@pytest.mark.parametrize(("a", "b"), [("ESCAVACAO MANUAL", "ESCAVACAO MECANICA"), ("A", "B"), ("", "X"), ("TUBO PVC", "TUBO PVC 25 MM")])
def test_similarity_follows_its_definition(spark, a, b):
    want = 0.0 if not a or not b else 1.0 if a == b else 0.82 + min(len(a), len(b)) / max(len(a), len(b)) * 0.16 if a.startswith(b) or b.startswith(a) else difflib.SequenceMatcher(None, a, b).ratio()
    assert value(spark, S.text_similarity(F.lit(a), F.lit(b))) == pytest.approx(want)


def test_span_and_neighbours(spark):
    words = lambda s: F.split(F.lit(s), " ")
    assert value(spark, S.best_span(words("b c d"), words("a b c d e"))) == 1.0
    assert value(spark, S.longest_common_words(F.lit("a b c d"), F.lit("x b c d y"))) == "b c d"
    assert value(spark, S.without_neighbours(F.lit("um dois tres quatro cinco"), F.array(F.lit("dois tres quatro")))) == "um cinco"
    assert value(spark, S.contains_description(F.lit("TUBO PVC"), F.lit("xx TUBO PVC yy")))


def test_registry_is_an_ordered_fold(spark):
    text = "FORNECIMENTO E INSTALACAO DE TUBO DE PVC SOLDAVEL"
    rows = pd.DataFrame([("k", 0, text[:20], 1.0), ("k", 1, text, 1.0), ("k", 2, text, 1.0), ("k", 3, "=>", 1.0)], columns=["key", "ord", "descricao", "weight"])
    df = spark.createDataFrame(rows).withColumn("upper", T.norm_upper(F.col("descricao")))
    r = evidence.description_registry(df).first()
    assert r.descricao == text and r.confirmed


def test_clusters_of_descriptions(spark):
    rows = [("k", 0, "TUBO DE PVC"), ("k", 1, "TUBO DE PVC 25"), ("k", 2, "AREIA MEDIA"), ("k", 3, "TUBO DE PVC")]
    got = evidence.description_clusters(spark.createDataFrame(rows, "key string, ord int, upper string")).orderBy("cluster").collect()
    assert [(r.head, r.n) for r in got] == [("TUBO DE PVC", 3), ("AREIA MEDIA", 1)] and all(r.conflict for r in got)


def test_budget_lines_become_a_tree(spark):
    lines = ["cabecalho", "1 SERVIÇOS PRELIMINARES", "1.1 PLACA DE OBRA", "1.1.1 74209/001 PLACA m² 6,00 500,00 3.000,00", "EM CHAPA"]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(lines)], "doc_id int, ord int, text string")
    got = sequence.budget_fold(df).collect()
    assert [(r.item, r.tipo) for r in got] == [("1", "meta"), ("1.1", "submeta"), ("1.1.1", "item")]
    assert got[2].custo_parcial == "3.000,00" and got[2].descricao.endswith("EM CHAPA")


def test_fixpoint_changes_nothing_twice(spark):
    rows = spark.createDataFrame([(1, "a", "p", "UN", None, "1"), (2, "a", "q", "", "X", ""), (3, "b", "q", "", "", "")], "id int, k1 string, k2 string, und string, descricao string, quant string")
    once, rounds = repair.to_fixpoint(rows, "id", ["k1", "k2"], ["und", "descricao"])
    again, more = repair.to_fixpoint(once, "id", ["k1", "k2"], ["und", "descricao"])
    assert rounds >= 1 and more == 0 and sorted(once.collect()) == sorted(again.collect())
    assert {r.id: r.quant for r in once.collect()} == {1: "1", 2: "", 3: ""}
    assert {r.und for r in once.collect()} == {"UN"}


def test_readers(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one\ntwo\x0cthree")
    pages = readers.decoded_pages(spark, str(tmp_path), lambda x: x.decode().split("\x0c"))
    assert readers.line_rows(pages).count() == 3
    payload = '{"tables":[{"table_id":"t","page":1,"family":"budget","columns":[{"canonical":"und","header":"UN","x0":1.0,"x1":2.0,"confidence":0.9}],"rows":[["a","b"],["c","d"]]}]}'
    (tmp_path / "t.json").write_text(payload)
    tables = readers.table_structures(spark, str(tmp_path / "t.json"))
    assert readers.structure_cells(tables).count() == 4 and readers.structure_columns(tables).first().canonical == "und"
    assert readers.layered({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}}


def test_stream_gives_what_a_batch_gives(spark, sf_dir, tmp_path):
    folder = tmp_path / "in"
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.write.parquet(str(folder))
    got = events.to_table(events.tumbling(events.read(spark, str(folder))), "tumbled", str(tmp_path / "ck"), "complete")
    assert sorted(got.collect()) == sorted(events.tumbling(batch).collect())
    assert events.sessions(batch).count() > 0


def test_sets_on_empty_tables(spark):
    none = spark.createDataFrame([], "k int, v string")
    assert sets.first_by(none, ["k"], ["v"]).count() == 0
    assert sets.upsert(none, none, "k", ["v"]).count() == 0
    assert sets.field_diff(none, none, "k", ["v"]).count() == 0


def test_resolve_sees_the_whole_unit_group_and_the_pool(spark):
    cols = "code string, bank string, item string, descricao string, unit string, price double, quant double"
    blocks = [(1, "900001", "SINAPI", "1.1", "TUBO PVC ESGOTO PREDIAL DN CINQUENTA", "M", 10.0, 1.0), (2, "900002", "SINAPI", "1.2", "TORNEIRA METAL CROMADA PAREDE COZINHA", "UN", 70.0, 2.0)]
    # the rarest words of the reference are found in other blocks of the unit
    blocks += [(10 + i, f"80000{i}", "SINAPI", f"7.{i}", f"{w} DIVERSO", "M", 500.0, 3.0) for i, w in enumerate(("TUBOS", "PVCX", "ESGOTOS", "PREDIALL"))]
    blocks += [(20 + i, f"70000{i}", "SINAPI", f"8.{i}", "DN CINQUENTA OUTRA COISA", "M", 900.0, 4.0) for i in range(5)]
    refs = [(1, "111111", "SINAPI", "7.0", "TUBOS PVCX ESGOTOS PREDIALL DN CINQUENTA", "M", 10.0, 1.0), (2, "222222", "SINAPI", "", "TORNEIRA METAL CROMADA PAREDE COZINHA", "PÇ", 70.0, 2.0)]
    got = {r.ref_id: r.block_id for r in linkage.resolve(spark.createDataFrame(refs, f"ref_id long, {cols}"), spark.createDataFrame(blocks, f"block_id long, {cols}")).collect()}
    assert got == {1: 1, 2: 2}
