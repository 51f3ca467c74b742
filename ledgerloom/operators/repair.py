"""Filling gaps from evidence, in rounds, until nothing changes.

Only empty fields are filled, and only with values that were extracted somewhere;
expected values from arithmetic go to columns of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import is_empty
from ..functions.rows import expected_tail
from ..lineage import cut

#: Rounds after which repair stops in any case.
MAX_ROUNDS = 8
#: Fields that belong to one row and are never taken over.
CONTEXTUAL = ("quant",)


def cross_fill(rows: DataFrame, row_id: str, key: str, fields: list[str], valid: dict[str, Column] | None = None) -> DataFrame:
    """Empty fields from the other rows of the key, where those agree on one value."""
    usable = [f for f in fields if f not in CONTEXTUAL]
    good = lambda f: ~is_empty(F.col(f)) & ((valid or {}).get(f, F.lit(True)))
    known = rows.groupBy(key).agg(*[x for f in usable for x in (F.min(F.when(good(f), F.col(f))).alias(f"lo_{f}"), F.max(F.when(good(f), F.col(f))).alias(f"hi_{f}"))])
    out = rows.join(known, key, "left")
    changes = {f: F.when(is_empty(F.col(f)) & (F.col(f"lo_{f}") == F.col(f"hi_{f}")), F.col(f"lo_{f}")).otherwise(F.col(f)) for f in usable}
    return out.withColumns(changes).select(*rows.columns)


def to_fixpoint(rows: DataFrame, row_id: str, keys: list[str], fields: list[str], rounds: int = MAX_ROUNDS) -> tuple[DataFrame, int]:
    """``cross_fill`` over each key in turn, again and again until a round fills nothing; the rows and the rounds that filled.

    Each round is cut off from the one before; only rows with an empty field take part in the count.
    """
    empty = lambda df: df.agg(F.sum(sum((is_empty(F.col(f)).cast("long") for f in fields), F.lit(0)))).first()[0] or 0
    now = cut(rows)
    left = empty(now)
    done = 0
    while left and done < rounds:
        new = now
        for key in keys:
            new = cross_fill(new, row_id, key, fields)
        new = cut(new)
        after = empty(new)
        if after == left:
            break
        now, left, done = new, after, done + 1
    return now, done


def row_status(missing: Column, math: Column, text_issue: Column, foreign: Column) -> Column:
    """closed_100, closed_with_warning or unresolved."""
    return F.when((F.size(missing) > 0) | (text_issue != ""), "unresolved").when((math == "mismatch") | foreign, "closed_with_warning").otherwise("closed_100")


def fill_tail(rows: DataFrame, text: str, expected: str | None = None) -> DataFrame:
    """Unit, quantity, price and total of rows that lack them, from the tail printed in their text.

    Where arithmetic tells what the total should be, the tail with that total is taken; nothing that is not printed is written.
    """
    tail = expected_tail(F.col(text), F.col(expected) if expected else F.lit(None).cast("string"))
    fields = ("und", "quant", "valor_unit", "total")
    out = rows.withColumn("tail", F.when(reduce(lambda a, b: a | b, [is_empty(F.col(f)) for f in fields]), tail))  # whole rows are not read again
    for f in fields:
        out = out.withColumn(f, F.when(is_empty(F.col(f)), F.col(f"tail.{f}")).otherwise(F.col(f)))
    return out.drop("tail")


def calculated(quantity: Column, unit: Column, total: Column) -> Column:
    """What arithmetic expects, apart from the public fields: total, unit price, and whether swapping the two alone closes the row."""
    swap = quantity.isNotNull() & (F.abs(quantity * unit - total) > 0.05) & (F.abs(quantity * total - unit) <= 0.05)
    return F.struct(F.when(total.isNull(), F.round(quantity * unit, 6)).alias("calc_total"), F.when(unit.isNull(), F.round(F.try_divide(total, quantity), 6)).alias("calc_unit"), F.coalesce(swap, F.lit(False)).alias("swap_closes"))
