"""The whole run: named stages over named relations, in order, with timers and issues."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numeric import clean, parse_lenient
from ..functions.rows import KIND, parse_row
from ..operators import evidence, quality, reconcile, repair, sequence
from ..sources.readers import line_rows

Relations = dict[str, DataFrame]


@dataclass
class Stage:
    name: str
    run: Callable[[Relations], Relations]
    blocking: bool = True


@dataclass
class Run:
    relations: Relations
    seconds: dict[str, float] = field(default_factory=dict)
    issues: list[tuple[str, str, str]] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not any(severity == "blocking" for _, severity, _ in self.issues)


def run(stages: list[Stage], relations: Relations) -> Run:
    """Runs the stages in order.  A failed stage becomes an issue, blocking if the stage is; later stages see what there is."""
    out = Run(dict(relations))
    for stage in stages:
        began = time.perf_counter()
        try:
            out.relations |= stage.run(out.relations)
        except Exception as e:  # noqa: BLE001  whatever it is, it is reported
            out.issues.append((stage.name, "blocking" if stage.blocking else "warning", f"{type(e).__name__}: {e}"[:300]))
        out.seconds[stage.name] = time.perf_counter() - began
    return out


def _lines(r: Relations) -> Relations:
    return {"lines": line_rows(r["pages"])}


def _rows(r: Relations) -> Relations:
    # a row has a kind if its line begins with one; asked of what was parsed, every line would be parsed twice
    parsed = r["lines"].where(clean(F.col("line")).rlike(KIND)).withColumn("r", parse_row(F.col("line"))).select("doc_id", "page", "line_no", "line", "r.*")
    kind = F.when(F.lower("kind").rlike("auxiliar"), "AUXILIAR").when(F.lower("kind").rlike("composi"), "COMPOSICAO").otherwise("INSUMO")
    parsed = parsed.withColumn("kind", kind).withColumn("key", T.code_key(F.col("codigo"), F.col("banco"))).withColumn("ord", F.col("page") * 100_000 + F.col("line_no"))
    return {"rows": sequence.blocks(parsed, "doc_id", ["ord"])}


def _fill(r: Relations) -> Relations:
    return {"rows": repair.fill_tail(r["rows"], "line")}


def _math(r: Relations) -> Relations:
    number = lambda c: parse_lenient(F.col(c))
    rows = r["rows"].where("block > 0").withColumn("amount", reconcile.line_total(number("total"), number("quant"), number("valor_unit")))
    math = reconcile.block_status(rows, ["doc_id", "block", "block_key"], F.col("kind") == "COMPOSICAO", "amount")
    return {"math": math.select(F.concat_ws("#", "doc_id", "block").alias("k"), "*").drop("doc_id", "block")}


def _evidence(r: Relations) -> Relations:
    rows = r["rows"].where("key <> ''")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("und", "valor_unit", "descricao")])
    long = rows.select("key", F.explode(fields).alias("x"), F.lit("physical_pdf_occurrence").alias("source"), F.lit(0.9).alias("confidence"), "page").select("key", "x.field", "x.value", "source", "confidence", "page").where("value <> ''")
    return {"evidence": long, "index": evidence.index(long)}


def _gate(r: Relations) -> Relations:
    rows = r["rows"].withColumn("missing", reconcile.missing_fields("und", "quant", "valor_unit", "total"))
    report = quality.gate(
        {
            "public_numeric_missing": (rows.where(F.size("missing") > 0), "blocking"), "component_math_unclosed": (r["math"].where(F.col("status").startswith("component_sum")), "warning"),
            "public_text_pollution": (rows.where(T.public_issue(F.col("descricao")) != ""), "warning"),
        }
    )
    return {"gate": report, "verdict": quality.passes(report)}


STAGES = [Stage("line scan", _lines), Stage("rows and blocks", _rows), Stage("tail recovery", _fill, False), Stage("component mathematics", _math, False), Stage("evidence index", _evidence, False), Stage("quality gate", _gate)]
