"""Queries on numbers in Brazilian notation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import rows as R
from ..operators import repair, sicro, structure
from .registry import query, spread, table

#: A price as the document prints it, and tokens that the readings differ on.
PT = "replace(replace(replace(format('{{:,.2f}}', {x}::DOUBLE), ',', 'X'), '.', ','), 'X', '.')"
PRICE_SQL = PT.format(x="l_extendedprice")
VARIANT_SQL = f"""CASE l_linenumber % 5
  WHEN 0 THEN {PRICE_SQL} WHEN 1 THEN 'R$ ' || {PRICE_SQL} WHEN 2 THEN CAST(CAST(floor(l_extendedprice) AS BIGINT) % 9 + 1 AS VARCHAR) || '.' || lpad(CAST(CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS VARCHAR), 3, '0')
  WHEN 3 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.5' ELSE 'COMP ' || CAST(l_partkey AS VARCHAR) END"""
KEYS = ["l_orderkey", "l_partkey", "l_linenumber"]


def variants(spark, sf_dir):
    """Line items with a token of one of five kinds."""
    whole = F.floor("l_extendedprice")
    token = (
        F.when(F.col("l_linenumber") % 5 == 0, N.format_ptbr(F.col("l_extendedprice"))).when(F.col("l_linenumber") % 5 == 1, F.concat(F.lit("R$ "), N.format_ptbr(F.col("l_extendedprice"))))
        .when(F.col("l_linenumber") % 5 == 2, F.concat((whole % 9 + 1).cast("string"), F.lit("."), F.lpad((whole % 1000).cast("string"), 3, "0")))
        .when(F.col("l_linenumber") % 5 == 3, F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(".5"))).otherwise(F.concat(F.lit("COMP "), F.col("l_partkey").cast("string")))
    )
    return table(spark, sf_dir, "lineitem").select(*KEYS, "l_quantity", "l_extendedprice", token.alias("token"))


def parse_oracle(value: str) -> str:
    return f"WITH t AS (SELECT l_orderkey, l_partkey, l_linenumber, {VARIANT_SQL} AS token FROM lineitem), b AS (SELECT *, replace(replace(token, 'R$', ''), ' ', '') AS s, replace(token, ' ', '') AS raw FROM t) SELECT l_orderkey, l_partkey, l_linenumber, token, {value} AS value FROM b"


_STRICT = r"CASE WHEN regexp_matches(s, '^-?(\d{1,3}(\.\d{3})*|\d+)(,\d+)?$') THEN try_cast(replace(replace(s, '.', ''), ',', '.') AS DOUBLE) END"
_DEC = "CASE WHEN regexp_matches(CASE WHEN contains(s, ',') THEN replace(replace(s, '.', ''), ',', '.') ELSE s END, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)$') THEN try_cast(CASE WHEN contains(s, ',') THEN replace(replace(s, '.', ''), ',', '.') ELSE s END AS DOUBLE) END"
_LENIENT = r"CASE WHEN regexp_matches(raw, '^-?[\d.,]+$') THEN try_cast(CASE WHEN contains(raw, ',') THEN replace(replace(raw, '.', ''), ',', '.') WHEN regexp_matches(raw, '^-?\d*(\.\d{3})+$') THEN replace(raw, '.', '') ELSE raw END AS DOUBLE) END"


@query(parse_oracle(_STRICT))
def ptbr_parse_strict(spark, sf_dir):
    return variants(spark, sf_dir).select(*KEYS, "token", N.parse_strict(F.col("token")).alias("value"))


@query(parse_oracle(_DEC))
def ptbr_parse_decimal(spark, sf_dir):
    return variants(spark, sf_dir).select(*KEYS, "token", N.parse_math(F.col("token")).alias("value"))


@query(parse_oracle(_LENIENT))
def ptbr_parse_lenient(spark, sf_dir):
    return variants(spark, sf_dir).select(*KEYS, "token", N.parse_lenient(F.col("token")).alias("value"))


@query(f"SELECT l_orderkey, l_partkey, l_linenumber, {PRICE_SQL} AS printed, round(l_extendedprice, 2) AS back FROM lineitem")
def ptbr_format(spark, sf_dir):
    printed = N.format_ptbr(F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select(*KEYS, printed.alias("printed"), F.round(N.parse_strict(printed), 2).alias("back"))


@query(f"""SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN contains(token, ',') THEN length(string_split(token, ',')[-1]) ELSE 0 END AS scale,
  CASE WHEN contains(token, ',') THEN length(string_split(token, ',')[-1]) ELSE 0 END > 0 AS lost FROM (SELECT *, {VARIANT_SQL} AS token FROM lineitem)""")
def decimal_scale(spark, sf_dir):
    t = F.col("token")
    return variants(spark, sf_dir).select(*KEYS, N.printed_scale(t).alias("scale"), N.scale_loss(t, F.regexp_replace(t, ",.*$", "")).alias("lost"))


@query("""SELECT l_orderkey, l_partkey, l_linenumber, replace(regexp_replace(regexp_replace(CASE WHEN abs(l_discount) < 1 THEN format('{:.7f}', l_discount) ELSE format('{:.4f}', l_discount) END, '0+$', ''), '\\.$', ''), '.', ',') AS discount,
  replace(regexp_replace(regexp_replace(CASE WHEN abs(l_quantity) < 1 THEN format('{:.7f}', l_quantity) ELSE format('{:.4f}', l_quantity) END, '0+$', ''), '\\.$', ''), '.', ',') AS quantity FROM lineitem""")
def public_number_text(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*KEYS, N.public_text(F.col("l_discount")).alias("discount"), N.public_text(F.col("l_quantity")).alias("quantity"))


_TRIPLE = """SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_quantity, p_retailprice, round(l_quantity * p_retailprice, 2) + CASE WHEN l_orderkey % 10 = 0 THEN 1.5 WHEN l_orderkey % 10 = 1 THEN 0.04 ELSE 0 END AS total FROM lineitem JOIN part ON l_partkey = p_partkey"""


def triplets(spark, sf_dir):
    """Quantity, unit price and a printed total that is off for every tenth order."""
    off = F.when(F.col("l_orderkey") % 10 == 0, 1.5).when(F.col("l_orderkey") % 10 == 1, 0.04).otherwise(0.0)
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(*KEYS, "l_extendedprice", "l_quantity", "p_retailprice", (F.round(F.col("l_quantity") * F.col("p_retailprice"), 2) + off).alias("total"))


@query(f"SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, CASE WHEN abs(l_quantity * p_retailprice - total) <= 0.05 THEN 'ok' ELSE 'mismatch' END AS status FROM ({_TRIPLE})")
def triplet_status(spark, sf_dir):
    return triplets(spark, sf_dir).select(*KEYS, "l_extendedprice", N.triplet_status(F.col("l_quantity"), F.col("p_retailprice"), F.col("total")).alias("status"))


_Q, _U, _T = PT.format(x="l_quantity"), PT.format(x="p_retailprice"), PT.format(x="round(l_quantity * p_retailprice, 2)")


@query(f"""WITH t AS (SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_orderkey % 7 AS m, l_quantity, p_retailprice, round(l_quantity * p_retailprice, 2) AS total FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, CASE m WHEN 0 THEN 'total' WHEN 1 THEN 'unit' WHEN 2 THEN 'quantity' END AS field,
  CASE m WHEN 0 THEN round(l_quantity * p_retailprice, 1) WHEN 1 THEN round(total / l_quantity, 1) WHEN 2 THEN round(total / p_retailprice, 1) END AS expected, CASE WHEN m <= 2 THEN false END AS public_write_allowed FROM t""")
def solve_triplet_missing(spark, sf_dir):
    m = F.col("l_orderkey") % 7
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    total = N.format_ptbr(F.round(F.col("l_quantity") * F.col("p_retailprice"), 2))
    found = N.solve_triplet(F.when(m == 2, "").otherwise(N.format_ptbr(F.col("l_quantity"))), F.when(m == 1, "").otherwise(N.format_ptbr(F.col("p_retailprice"))), F.when(m == 0, "").otherwise(total))
    rows = rows.withColumn("s", found)
    return rows.select(*KEYS, "l_extendedprice", "s.field", F.round(N.parse_lenient(F.col("s.expected")), 1).alias("expected"), "s.public_write_allowed")


ROW_TEXT_SQL = f"""SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, 'Insumo ' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || ' SINAPI ' || upper(p_name) || ' TIPO ' || p_type || ' UN ' || {PT.format(x="l_quantity")} || ' ' || {PT.format(x="p_retailprice")} || ' ' || {PT.format(x="l_extendedprice")} AS line,
  {PT.format(x="l_quantity")} AS quant, {PT.format(x="p_retailprice")} AS valor_unit, {PT.format(x="l_extendedprice")} AS total, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS codigo, upper(p_name) || ' TIPO ' || p_type AS descricao FROM lineitem JOIN part ON l_partkey = p_partkey"""


def row_texts(spark, sf_dir):
    """Composition rows as a document prints them."""
    rows = spread(table(spark, sf_dir, "lineitem").select(*KEYS, "l_quantity", "l_extendedprice"))
    rows = rows.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    line = F.concat(
        F.lit("Insumo "), F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.lit(" SINAPI "), F.upper("p_name"), F.lit(" TIPO "), F.col("p_type"), F.lit(" UN "),
        N.format_ptbr(F.col("l_quantity")), F.lit(" "), N.format_ptbr(F.col("p_retailprice")), F.lit(" "), N.format_ptbr(F.col("l_extendedprice")),
    )
    return rows.select(*KEYS, "l_extendedprice", line.alias("line"))


@query(f"SELECT l_orderkey, l_partkey, l_linenumber, 'UN' AS und, quant, valor_unit, total, 'consistent' AS state FROM ({ROW_TEXT_SQL})")
def numeric_tail_extract(spark, sf_dir):
    rows = row_texts(spark, sf_dir).withColumn("t", R.numeric_tail(F.col("line")))
    return rows.select(*KEYS, "t.und", "t.quant", "t.valor_unit", "t.total", R.tail_status(F.col("line")).alias("state"))


@query(f"SELECT l_orderkey, l_partkey, l_linenumber, 'Insumo' AS kind, codigo, 'SINAPI' AS banco, descricao, 'UN' AS und, total FROM ({ROW_TEXT_SQL})")
def row_parse(spark, sf_dir):
    rows = row_texts(spark, sf_dir).withColumn("r", R.parse_row(F.col("line")))
    return rows.select(*KEYS, "r.kind", "r.codigo", "r.banco", "r.descricao", "r.und", "r.total")


@query(f"SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'KG' ELSE 'UN' END AS und, CASE WHEN l_linenumber % 3 = 0 THEN '9,99' ELSE total END AS total FROM ({ROW_TEXT_SQL})")
def fill_numeric_tail(spark, sf_dir):
    rows = row_texts(spark, sf_dir).select(*KEYS, "line", F.when(F.col("l_linenumber") % 2 == 0, "KG").otherwise("").alias("und"), F.lit("").alias("quant"), F.lit(None).cast("string").alias("valor_unit"), F.when(F.col("l_linenumber") % 3 == 0, "9,99").otherwise("").alias("total"))
    return repair.fill_tail(rows, "line").select(*KEYS, "und", "total")


@query("""SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN round(l_quantity * l_discount, 6) END AS calc_total, CASE WHEN l_linenumber % 3 = 1 THEN round(l_extendedprice / l_quantity, 6) END AS calc_unit FROM lineitem""")
def calculated_fields(spark, sf_dir):
    m = F.col("l_linenumber") % 3
    rows = table(spark, sf_dir, "lineitem")
    rows = rows.withColumn("c", repair.calculated(F.col("l_quantity"), F.when(m != 1, F.col("l_discount")), F.when(m != 0, F.col("l_extendedprice"))))
    return rows.select(*KEYS, "c.calc_total", "c.calc_unit")


_SECTION = "CASE l_linenumber % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' WHEN 4 THEN 'E' ELSE 'F' END"
_COST = f"""CASE {_SECTION} WHEN 'A' THEN l_quantity * (l_discount * 100 + l_tax * 10) WHEN 'F' THEN l_quantity * (l_tax * 3 + l_discount * 2 + l_tax * l_discount) ELSE l_quantity * l_discount END"""


def section_rows(spark, sf_dir):
    """Line items as rows of the six sections."""
    section = F.element_at(F.array(*map(F.lit, "ABCDEF")), (F.col("l_linenumber") % 6 + 1).cast("int"))
    road = lambda dmt, price: F.struct(dmt.cast("double").alias("dmt"), price.cast("double").alias("price"))
    d, t = F.col("l_discount"), F.col("l_tax")
    cost = sicro.row_cost(section, F.col("l_quantity"), d, t, F.lit(100.0), F.lit(10.0), d, F.array(road(t, F.lit(3.0)), road(d, F.lit(2.0)), road(t, d)))
    return table(spark, sf_dir, "lineitem").select(*KEYS, "l_extendedprice", section.alias("section"), F.round(cost, 4).alias("cost"))


@query(f"SELECT l_orderkey, l_partkey, l_linenumber, {_SECTION} AS section, round({_COST}, 4) AS cost FROM lineitem")
def sicro_formula_rows(spark, sf_dir):
    return section_rows(spark, sf_dir).select(*KEYS, "section", "cost")


@query(f"""SELECT l_orderkey, section, round(sum(cost), 4) AS total, count(*) AS n_rows, CASE WHEN l_orderkey % 5 = 0 THEN 'mismatch' ELSE 'ok' END AS status FROM (SELECT *, {_SECTION} AS section, round({_COST}, 4) AS cost FROM lineitem) GROUP BY ALL""")
def sicro_section_totals(spark, sf_dir):
    rows = section_rows(spark, sf_dir)
    off = F.when(F.col("l_orderkey") % 5 == 0, 1.0).when(F.col("l_orderkey") % 5 == 1, 0.01).otherwise(0.0)
    reported = rows.where(F.col("l_orderkey") % 5 != 4).groupBy("l_orderkey", "section").agg(F.sum("cost").alias("s")).select("l_orderkey", "section", (F.col("s") + off).alias("reported"))
    out = sicro.section_totals(rows, reported, ["l_orderkey", "section"], "cost")
    return out.select("l_orderkey", "section", F.round("total", 4).alias("total"), "n_rows", "status")


@query("""SELECT p_partkey, p_size + 1.0::DOUBLE AS q, p_retailprice AS u, round((p_size + 1) * p_retailprice, 4) AS t FROM part""")
def layout_permutation(spark, sf_dir):
    q, u = F.col("p_size") + 1.0, F.col("p_retailprice")
    t = F.round(q * u, 4)
    shuffled = F.when(F.col("p_partkey") % 3 == 0, F.array(q, u, t)).when(F.col("p_partkey") % 3 == 1, F.array(t, q, u)).otherwise(F.array(u, t, q))
    rows = table(spark, sf_dir, "part").withColumn("o", structure.closing_order(shuffled))
    return rows.select("p_partkey", F.least("o.q", "o.u").alias("q"), F.greatest("o.q", "o.u").alias("u"), "o.t")


@query("""SELECT a.p_partkey, a.p_size, abs(a.p_retailprice - b.p_retailprice) <= greatest(0.1, 0.03 * greatest(abs(a.p_retailprice), abs(b.p_retailprice), 1.0)) AS close FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 13""")
def tolerance_compare(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    other = p.select((F.col("p_partkey") - 13).alias("p_partkey"), F.col("p_retailprice").alias("other"))
    return p.join(other, "p_partkey").select("p_partkey", "p_size", N.close(F.col("p_retailprice"), F.col("other")).alias("close"))
