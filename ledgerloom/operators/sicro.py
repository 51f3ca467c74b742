"""Hourly-cost compositions with sections A to F."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import DECIMAL

ROW_TOLERANCE, SECTION_TOLERANCE = 0.01, 0.02


def row_cost(section: Column, q: Column, use_op: Column, use_idle: Column, cost_op: Column, cost_idle: Column, price: Column, transport: Column) -> Column:
    """The cost of a row by its section.

    A equipment: quantity times use times cost, working and idle; B labour, C
    material, D auxiliary, E fixed time: quantity times price; F transport: quantity
    times distance times price, over the kinds of road (``transport``: array of dmt, price).
    """
    haul = F.aggregate(transport, F.lit(0).cast("double"), lambda s, x: s + x["dmt"] * x["price"])
    return F.when(section == "A", q * (use_op * cost_op + use_idle * cost_idle)).when(section.isin("B", "C", "D", "E"), q * price).when(section == "F", q * haul)


def row_status(calculated: Column, printed: Column, tolerance: float = ROW_TOLERANCE) -> Column:
    return F.when(calculated.isNull() | printed.isNull(), "missing").when(F.abs(calculated - printed) <= tolerance, "ok").otherwise("mismatch")


def section_totals(rows: DataFrame, reported: DataFrame, keys: list[str], cost: str) -> DataFrame:
    """Sums of sections against what is reported; a section without a report is all right."""
    sums = rows.groupBy(*keys).agg(F.sum(cost).alias("total"), F.count(F.lit(1)).alias("n_rows"))
    out = sums.join(reported, keys, "left")
    ok = F.col("reported").isNull() | (F.abs(F.col("total") - F.col("reported")) <= SECTION_TOLERANCE)
    return out.withColumn("status", F.when(ok, "ok").otherwise("mismatch"))


def principal_status(q: Column, unit_cost: Column, total: Column) -> Column:
    return F.when(F.abs(q * unit_cost - total) <= 0.05, "ok").otherwise("mismatch")


def repaired(numbers: Column, tolerance: float = ROW_TOLERANCE) -> Column:
    """Of the last numbers of a row the three that, as quantity, price and cost, close it best; null if none do."""
    n = F.size(numbers)
    places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    at = lambda i: F.try_element_at(numbers, i)
    trio = lambda i, j: F.transform(places, lambda k: F.struct(F.abs(at(i) * at(j) - at(k)).alias("delta"), (k - j).alias("far"), at(i).alias("q"), at(j).alias("price"), at(k).alias("cost"), i.alias("i"), j.alias("j"), k.alias("k")))
    every = F.flatten(F.transform(places, lambda i: F.flatten(F.transform(places, lambda j: trio(i, j)))))
    good = F.filter(every, lambda x: (x["i"] != x["j"]) & (x["j"] != x["k"]) & (x["i"] != x["k"]) & (x["delta"] <= tolerance) & (x["cost"] > 0))
    best = F.array_min(F.transform(good, lambda x: F.struct(x["delta"].alias("delta"), F.abs(x["k"] - n).alias("end"), x["i"].alias("i"), x["j"].alias("j"), x["q"].alias("q"), x["price"].alias("price"), x["cost"].alias("cost"))))
    return F.when(n >= 3, best)


def code_class(code: Column) -> Column:
    """What a code stands for: seven digits a composition, else by its letter."""
    return (
        F.when(code.rlike(r"^\d{7}$"), "composicao_principal").when(code.rlike(r"^E\d{4}$"), "equipamento").when(code.rlike(r"^P\d{4}$"), "mao_obra").when(code.rlike(r"^M\d{4}$"), "material").otherwise("unknown")
    )


def code_and_bank(a: Column, b: Column) -> Column:
    """Code and bank in whichever order they come."""
    is_bank = lambda c: F.upper(c).rlike(r"^(SICRO\d?|SINAPI|PR[ÓO]PRIO|ANP|DNIT)$")
    turned = is_bank(a) & ~is_bank(b)
    bank = F.regexp_replace(F.upper(F.when(turned, a).otherwise(b)), r"^SICRO\d$", "SICRO")
    return F.struct(F.when(turned, b).otherwise(a).alias("codigo"), bank.alias("banco"), turned.alias("inverted"))


def parse_section_line(section: str, line: Column) -> Column:
    """The printed fields of a C, D or E row: quantity, unit, price and cost as text, code and bank."""
    s = F.regexp_replace(F.trim(line), r"\s+", " ")
    number = r"(\d{1,3}(?:\.\d{3})*,\d+)"
    if section == "E":
        pattern = rf"^Tempo Fixo\s+(SICRO\d?|SINAPI)\s+([A-Z]?\d+)\s+(.*?)\s+(\d{{7}})\s+{number}\s+(\S+)\s+{number}\s+{number}$"
        part = lambda i: F.regexp_extract(s, pattern, i)
        fields = {"banco": 1, "insumo": 2, "descricao": 3, "codigo": 4, "quantidade": 5, "unidade": 6, "preco_unitario": 7, "custo": 8}
    else:
        pattern = rf"^(?:Insumo|Atividade Auxiliar)\s+(SICRO\d?|SINAPI)\s+([A-Z]?\d+)\s+(.*?)\s+{number}\s+(\S+)\s+{number}\s+{number}$"
        if section == "C":
            pattern = pattern.replace("(?:Insumo|Atividade Auxiliar)", "Insumo")
        part = lambda i: F.regexp_extract(s, pattern, i)
        fields = {"banco": 1, "codigo": 2, "descricao": 3, "quantidade": 4, "unidade": 5, "preco_unitario": 6, "custo": 7}
    value = {k: part(i) for k, i in fields.items()}
    value["banco"] = F.regexp_replace(value["banco"], r"^SICRO\d$", "SICRO")
    return F.when(s.rlike(pattern), F.struct(*[v.alias(k) for k, v in value.items()]))


def as_decimal(c: Column) -> Column:
    return c.cast(DECIMAL)
