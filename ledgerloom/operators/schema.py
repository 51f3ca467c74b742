"""What tables lack against the columns expected of them, and where the sections of a page begin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clean
from ..functions.text import norm_upper

#: Banks, and short words that are no units.
BANK_TOKENS = ["SINAPI", "SICRO", "SICRO3", "PROPRIO", "ORSE", "SEINFRA", "SBC", "SEDOP", "EMBASA", "CPOS", "DER", "DNIT", "ANP"]
NOT_UNITS = ["DE", "DO", "DA", "EM", "COM", "PARA", "E", "TIPO"]
#: What section headers say, and the columns of each section.
SECTION_HEADERS = {
    "A": ["EQUIP"], "B": ["MAO DE OBRA"], "C": ["MATERIAL"], "D": ["ATIVIDADES AUXILIARES"], "E": ["TEMPO FIXO", "TEMPOS FIXOS"], "F": ["MOMENTO DE TRANSPORTE", "DMT", "LN RP P"],
}
SECTION_COLUMNS = {
    "A": ["controle_linha", "codigo", "banco", "equipamento", "quantidade", "utilizacao.operativa", "utilizacao.improdutiva", "custo_operacional.operativa", "custo_operacional.improdutiva", "custo_horario"],
    "B": ["controle_linha", "codigo", "banco", "mao_obra", "quantidade", "salario_hora", "custo_horario"],
    "C": ["controle_linha", "banco", "codigo", "material", "quantidade", "unidade", "preco_unitario", "custo_horario"],
    "D": ["controle_linha", "banco", "codigo", "atividade_auxiliar", "quantidade", "unidade", "preco_unitario", "custo_horario"],
    "E": ["controle_linha", "banco", "insumo", "tempo_fixo", "codigo", "quantidade", "unidade", "preco_unitario", "custo_horario"],
    "F": ["controle_linha", "banco", "insumo", "momento_transporte", "quantidade", "unidade", "dmt.LN", "dmt.RP", "dmt.P", "custo_horario"],
}
#: Columns whose absence is grave.
CORE = ["codigo", "banco", "descricao"]


def kind_of(column: Column) -> Column:
    """What a column of that name holds: code, bank, unit, number, money or text."""
    money = column.isin("valor_unit", "total", "custo_unitario_sem_bdi", "custo_unitario_com_bdi", "custo_parcial", "custo_total")
    return (
        F.when(column.isin("codigo", "cod"), "code").when(column.isin("banco", "fonte"), "bank").when(column.isin("und", "unidade"), "unit")
        .when(column.isin("quant", "quantidade"), "number").when(money, "money").otherwise("text")
    )


def kinds(text: Column) -> Column:
    """All kinds of column that could hold a word."""
    s, upper = clean(text), norm_upper(text)
    bank = upper.isin(*BANK_TOKENS)
    unit = F.replace(F.replace(upper, F.lit("M2"), F.lit("M²")), F.lit("M3"), F.lit("M³")).rlike("^[A-Z%]{1,6}[²³]?$") & ~upper.isin(*NOT_UNITS)
    code = s.rlike(r"^\d{2,}(/\d{1,4})?$") | (s.rlike(r"\d") & s.rlike(r"^[A-Za-zÁ-Úá-ú]{1,8}([\s./_-]*[A-Za-z0-9Á-Úá-ú]+)+$"))
    number = s.rlike(r"^[-+]?\d[\d.,]*$")
    money = F.trim(F.replace(s, F.lit("R$"), F.lit(""))).rlike(r"^[-+]?\d[\d.,]*$")
    named = {"code": code & ~bank & ~unit, "bank": bank, "unit": unit, "number": number, "money": money, "text": s != ""}
    return F.array_compact(F.array(*[F.when(cond, name) for name, cond in named.items()]))


def _names(c: str) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def gaps(tables: DataFrame, table: str = "table_id", available: str = "available", expected: str = "expected") -> DataFrame:
    """A row for each expected column that a table lacks: its place, and the nearest columns on both sides that the table has.

    Null lists are empty; empty and repeated names do not count.
    """
    t = tables.select(table, _names(available).alias("available"), _names(expected).alias("expected"))
    t = t.select("*", F.posexplode("expected").alias("at", "missing")).where(~F.array_contains("available", F.col("missing")))
    has = lambda part: F.filter(part, lambda c: F.array_contains("available", c))
    left = F.try_element_at(has(F.slice("expected", F.lit(1), F.col("at"))), F.lit(-1))
    right = F.try_element_at(has(F.slice("expected", F.col("at") + 2, F.size("expected"))), F.lit(1))
    return t.select(table, "at", "missing", left.alias("left"), right.alias("right"))


def merge_plan(tables: DataFrame, samples: DataFrame | None = None, table: str = "table_id") -> DataFrame:
    """Which column a missing one was printed into: its right neighbour, else its left one.

    ``samples`` are words by ``table`` and ``column``; in a table that has any, a neighbour
    counts only if one of its words could stand in the missing column.  A table without
    samples, or of null id, goes by place alone, which is less sure.
    """
    missing = gaps(tables, table)
    sides = missing.select(table, "missing", F.posexplode(F.array_compact(F.array("right", "left"))).alias("side", "source"))
    if samples is None:
        samples = tables.select(table, F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("text")).limit(0)
    words = samples.select(table, F.lower(F.trim("column")).alias("source"), F.explode(F.concat(kinds(F.col("text")), F.array(F.lit("any")))).alias("kind"))
    counts = words.groupBy(table, "source", "kind").agg(F.count(F.lit(1)).alias("n"))
    sampled = counts.where("kind = 'any'").select(table, F.lit(True).alias("sampled")).distinct()
    found = sides.withColumn("kind", kind_of(F.col("missing"))).join(counts.hint("merge"), [table, "source", "kind"], "left").join(sampled.hint("merge"), table, "left")
    found = found.where("sampled is null or n > 0")
    best = found.groupBy(table, "missing").agg(F.min_by(F.struct("source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("sampled", F.lit(False)).alias("sampled")), "side").alias("b"))
    return best.select(
        table, "missing", F.col("b.source").alias("source"), F.when(F.col("b.sampled"), "words").otherwise("place").alias("method"), F.when(F.col("b.sampled"), 0.86).otherwise(0.68).alias("confidence"), F.when(F.col("b.sampled"), F.col("b.n")).otherwise(0).alias("sample_rows"),
    )


def anomalies(columns: DataFrame, expected: DataFrame, table: str = "table_id") -> DataFrame:
    """A row for each expected column that a table lacks, and whether a neighbour's header names both.

    ``columns`` has table, index, canonical and header of the columns found; ``expected``
    table, index, canonical and header of those there should be.  A header that is null or
    empty is taken to be the name.  Tables that lack nothing, or of which nothing is
    expected, give no row.
    """
    listed = lambda df, name: df.where("trim(canonical) <> ''").groupBy(table).agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "canonical"))), lambda x: x["canonical"]).alias(name))
    # merge: rows that come of arrays are many more than the file's size makes Spark think, and are not to be broadcast
    missing = gaps(listed(expected, "expected").join(listed(columns, "available").hint("merge"), table, "left"), table)
    named = F.coalesce(F.when(clean("header") != "", F.col("header")), F.col("canonical"))
    heads = expected.groupBy(table, F.lower(F.trim("canonical")).alias("name")).agg(norm_upper(F.min_by(named, "index")).alias("head"))
    rows = missing.join(heads.withColumnsRenamed({"name": "missing", "head": "own"}).hint("merge"), [table, "missing"])
    sides = rows.select(table, "missing", "own", F.explode(F.array_compact(F.array("left", "right"))).alias("name")).join(heads.hint("merge"), [table, "name"])
    printed = columns.select(table, "index", F.lower(F.trim("canonical")).alias("name"), norm_upper(F.col("header")).alias("printed"))
    fused = sides.join(printed.hint("merge"), [table, "name"]).where((F.col("own") != F.col("head")) & F.contains("printed", F.col("own")) & F.contains("printed", F.col("head")))
    fused = fused.groupBy(table, "missing").agg(F.min_by("name", F.struct("index", "name")).alias("fused_with"))
    code = F.when(F.col("fused_with").isNotNull(), "fused_header_detected").otherwise("missing_expected_column")
    severity = F.when(F.col("missing").isin(*CORE), "high").otherwise("medium")
    return rows.join(fused.hint("merge"), [table, "missing"], "left").select(table, "missing", "left", "right", code.alias("code"), severity.alias("severity"), "fused_with")


def section_of(text: Column) -> Column:
    """The section a header line opens: its letter in front, else by its words; null for other lines."""
    s = norm_upper(text)
    by_words = F.coalesce(*[F.when(s.rlike("|".join(words)), name) for name, words in SECTION_HEADERS.items()])
    return F.coalesce(F.when(s.rlike(r"^[A-F]\b"), F.substring(s, 1, 1)), by_words)


def section_map(lines: DataFrame, doc: str = "doc", page: str = "page", order: str = "line_no", text: str = "text") -> DataFrame:
    """The first header line of each section in a document, with its place x0, x1, y0, y1 and the section's columns."""
    box = [F.round(c, 3).alias(c) for c in ("x0", "x1", "y0", "y1")]
    heads = lines.withColumn("section", section_of(F.col(text))).where("section is not null")
    first = heads.groupBy(doc, "section").agg(F.min_by(F.struct(F.col(page).alias("page"), clean(text).alias("header"), *box), F.struct(page, order, text)).alias("h"))
    columns = F.coalesce(*[F.when(F.col("section") == s, F.array(*map(F.lit, names))) for s, names in SECTION_COLUMNS.items()])
    return first.select(doc, "section", "h.*", columns.alias("columns"), F.lit(0.72).alias("confidence"))
