"""Numbers in Brazilian notation, as Columns.

The domain has several readings of the same token ("1.234", "12.5") that must not
be confused, so each is a function of its own.  All return null for what they
cannot read and never fail.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number with dots for thousands only: 1.234,56 or 1234,56.
STRICT = r"^-?(\d{1,3}(\.\d{3})*|\d+)(,\d+)?$"
DECIMAL = "decimal(38,18)"


def clean(c: Column) -> Column:
    """Text with no-break spaces as spaces, runs of white space as one, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), " ", " "), r"\s+", " "))


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(clean(c), r"R\$", ""), " ", "")


def _comma_decimal(c: Column) -> Column:
    """Dots dropped, the comma as a point."""
    return F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))


def parse_strict(c: Column) -> Column:
    """1.234 is 1234; 12.5 is nothing."""
    s = _bare(c)
    return F.when(s.rlike(STRICT), _comma_decimal(s).try_cast("double"))


def parse_decimal(c: Column) -> Column:
    """Exact.  Dots are thousands only beside a comma, so 1.234 is 1.234."""
    s = _bare(c)
    plain = F.when(s.contains(","), _comma_decimal(s)).otherwise(s)
    return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), plain.try_cast(DECIMAL))


def parse_lenient(c: Column) -> Column:
    """1.234 is 1234 and 12.5 is 12.5: without a comma, dots are thousands if three digits follow each.  Codes are nothing."""
    s = F.replace(clean(c), F.lit(" "), F.lit(""))
    number = F.when(s.contains(","), _comma_decimal(s)).when(s.rlike(r"^-?\d*(\.\d{3})+$"), F.replace(s, F.lit("."), F.lit(""))).otherwise(s)
    return F.when(s.rlike(r"^-?[\d.,]+$") & number.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), number.try_cast("double"))


def parse_math(c: Column) -> Column:
    """As ``parse_decimal``, as a double: 1.234 is 1.234."""
    return parse_decimal(c).cast("double")


def printed_scale(c: Column) -> Column:
    """Digits after the last comma."""
    s = F.trim(F.regexp_replace(clean(c), r"R\$", ""))
    return F.when(s.contains(","), F.length(F.substring_index(s, ",", -1))).otherwise(F.lit(0))


def numeric_source(c: Column) -> Column:
    """What was printed, its exact value and its scale."""
    s = clean(c)
    return F.struct(s.alias("source_text"), parse_decimal(s).alias("decimal"), printed_scale(s).alias("scale"))


def scale_loss(source: Column, exported: Column) -> Column:
    """True if an exported number shows fewer decimals than the document."""
    return printed_scale(exported) < printed_scale(source)


def format_ptbr(c: Column, decimals: int = 2) -> Column:
    """1234.5 as 1.234,50; null as empty."""
    return F.coalesce(F.translate(F.format_number(c, decimals), ",.", ".,"), F.lit(""))


def public_text(c: Column) -> Column:
    """A double as the public text of a number: 7 decimals below one, else 4, no trailing zeros, a comma, no thousands."""
    digits = F.when(F.abs(c) < 1, F.format_string("%.7f", c)).otherwise(F.format_string("%.4f", c))
    return F.when(c.isNotNull(), F.replace(F.regexp_replace(F.regexp_replace(digits, r"0+$", ""), r"\.$", ""), F.lit("."), F.lit(",")))


def close(a: Column, b: Column, rel: float = 0.03, abs_tol: float = 0.1) -> Column:
    """Within a tolerance that grows with the larger of the two; false if either is missing."""
    size = F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(float(abs_tol)), F.lit(float(rel)) * size), F.lit(False))


def round_half_up(c: Column, digits: int) -> Column:
    """Of an exact decimal."""
    return F.round(c.cast(DECIMAL), digits)


def is_empty(c: Column) -> Column:
    """Null and empty text count as absent, here and everywhere else."""
    return c.isNull() | (c == "")


def triplet_status(q: Column, u: Column, t: Column, tolerance: float = 0.05) -> Column:
    """missing_values, ok or mismatch for q * u = t."""
    return F.when(q.isNull() | u.isNull() | t.isNull(), "missing_values").when(F.abs(q * u - t) <= tolerance, "ok").otherwise("mismatch")


def solve_triplet(q: Column, u: Column, t: Column) -> Column:
    """The one unknown of q * u = t: field, expected value and rule; never written to a public field.

    Null unless exactly one of the three texts is empty and the others are numbers.
    """
    qn, un, tn = parse_lenient(q), parse_lenient(u), parse_lenient(t)
    one = (is_empty(q).cast("int") + is_empty(u).cast("int") + is_empty(t).cast("int")) == 1

    def found(field: str, value: Column, rule: str, decimals: int) -> Column:
        return F.struct(F.lit(field).alias("field"), format_ptbr(value, decimals).alias("expected"), F.lit(rule).alias("rule"), F.lit(False).alias("public_write_allowed"))

    return (
        F.when(one & is_empty(t) & qn.isNotNull() & un.isNotNull(), found("total", qn * un, "total=q_times_unit", 2))
        .when(one & is_empty(u) & tn.isNotNull() & (qn != 0), found("unit", F.try_divide(tn, qn), "unit=total_div_q", 2))
        .when(one & is_empty(q) & tn.isNotNull() & (un != 0), found("quantity", F.try_divide(tn, un), "q=total_div_unit", 7))
    )
