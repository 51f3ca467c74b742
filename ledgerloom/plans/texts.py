"""Queries on text: normal forms, predicates, classifiers and measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import rows as R
from ..functions import similarity as S
from ..functions import text as T
from ..functions.numeric import clean
from ..operators import sicro
from ..sources.readers import line_rows
from .numbers import PT, row_texts
from .registry import query, spread, table

_UNMARK = f"translate({{x}}, '{T.MARKED}', '{T.PLAIN}')"
_CLEAN = r"trim(regexp_replace(coalesce({x}, ''), '[ \t\n\r\x0B\f]+', ' ', 'g'))"
CLEAN = _CLEAN.format(x="text")
UPPER = "upper(" + _UNMARK.format(x=f"upper(replace({CLEAN}, 'ß', 'SS'))") + ")"
STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
TOKENS = f"list_filter(list_distinct(regexp_extract_all({UPPER}, '[A-Z0-9]+')), lambda x: length(x) > 1 AND NOT list_contains({STOP}, x))"


@query(rf"""SELECT doc_id, line_no, line FROM (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS line_no, trim(regexp_replace(unnest(parts), '[ \t\r\x0B\f]+', ' ', 'g')) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)) WHERE line <> ''""")
def line_explode(spark, sf_dir):
    return line_rows(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("line_no", F.col("line_no").cast("long"))


#: Markers that the invented prose has.
DROP, STRIP, TOXIC = ["$$$", "license"], [" the ", " de "], ["###", "!!"]


@query(r"""WITH l AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '[ \t\r\x0B\f]+', ' ', 'g')) AS s FROM documents),
c AS (SELECT doc_id, CASE WHEN instr(s, ' the ') > 0 OR instr(s, ' de ') > 0 THEN trim(substr(s, 1, least(CASE WHEN instr(s, ' the ') > 0 THEN instr(s, ' the ') ELSE 1000000 END, CASE WHEN instr(s, ' de ') > 0 THEN instr(s, ' de ') ELSE 1000000 END) - 1)) ELSE s END AS s FROM l WHERE s <> '')
SELECT doc_id, count(*) AS n_lines, sum(length(s))::BIGINT AS n_chars FROM c WHERE s <> '' AND NOT contains(s, '$$$') AND NOT contains(s, 'license') GROUP BY doc_id""")
def sanitize_lines(spark, sf_dir):
    kept = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.sanitized_lines(F.col("text"), DROP, STRIP)).alias("s"))
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("s")).alias("n_chars"))


@query(r"""WITH l AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '[ \t\r\x0B\f]+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, count(*) FILTER (s <> '' AND NOT regexp_matches(s, '^\d+(\.\d+)*\s+\S+') AND NOT contains(s, '###') AND NOT contains(s, '!!')) AS safe, count(*) AS n FROM l GROUP BY doc_id""")
def continuation_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("s"))
    return lines.groupBy("doc_id").agg(F.count_if(T.safe_continuation(F.col("s"), TOXIC)).alias("safe"), F.count(F.lit(1)).alias("n"))


@query(r"""SELECT doc_id, length(text) - length(replace(text, '###', '')) AS marked, length(regexp_replace(text, '(###|!!)', chr(10) || '\1', 'g')) AS broken FROM documents""")
def break_markers(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", (F.length(t) - F.length(F.replace(t, F.lit("###"), F.lit("")))).cast("long").alias("marked"), F.length(T.break_before(t, ["###", "!!"])).cast("long").alias("broken"))


@query(f"""SELECT doc_id, list_sort({TOKENS}) AS words, len({TOKENS}) AS n FROM documents""")
def tokens(spark, sf_dir):
    t = T.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sort_array(t).alias("words"), F.size(t).cast("long").alias("n"))


_STEM_CASE = "CASE " + " ".join(f"WHEN length(w) - {len(s)} >= 4 AND w LIKE '%{s}' THEN substr(w, 1, length(w) - {len(s)})" for s in T.STEM_SUFFIXES) + " ELSE w END"


@query(f"""WITH w AS (SELECT DISTINCT unnest({TOKENS}) AS w FROM documents), s AS (SELECT w, {_STEM_CASE} AS s FROM w) SELECT w AS word, CASE WHEN s LIKE 'PRE%' AND length(s) > 7 THEN substr(s, 4) ELSE s END AS stem FROM s""")
def semantic_stem(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", T.stem(F.col("word")).alias("stem"))


_PAIRS = f"""WITH d AS (SELECT doc_id, {TOKENS} AS t FROM documents), p AS (SELECT a.doc_id AS a, a.t AS x, b.t AS y FROM d a JOIN d b ON b.doc_id = a.doc_id + 1)"""


def pairs(spark, sf_dir):
    """Each document beside the one with the next id."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("a"), T.tokens(F.col("text")).alias("x"))
    return d.join(d.select((F.col("a") - 1).alias("a"), F.col("x").alias("y")), "a")


_SHARE = "CASE WHEN len(x) > 0 AND len(y) > 0 THEN round(len(list_intersect(x, y)) / {of}, 6) ELSE 0 END"


@query(f"""{_PAIRS} SELECT a, {_SHARE.format(of="len(list_distinct(list_concat(x, y)))")} AS jaccard, {_SHARE.format(of="greatest(len(x), len(y))")} AS of_larger, {_SHARE.format(of="least(len(x), len(y))")} AS of_smaller FROM p""")
def set_similarity(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    return pairs(spark, sf_dir).select("a", F.round(S.jaccard(x, y), 6).alias("jaccard"), F.round(S.overlap_of_larger(x, y), 6).alias("of_larger"), F.round(S.overlap_of_smaller(x, y), 6).alias("of_smaller"))


@query(f"""WITH d AS (SELECT doc_id, replace({UPPER}, ' ', '') AS s FROM documents)
SELECT doc_id, CASE WHEN s = '' THEN 0 ELSE len(list_distinct(list_transform(range(1, greatest(length(s) - 2, 1) + 1), lambda i: substr(s, i, 3)))) END AS n FROM d""")
def char_trigrams(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(S.char_trigrams(F.col("text"))).cast("long").alias("n"))


@query()
def sequence_similarity(spark, sf_dir):
    """Matching blocks have no counterpart in SQL; tests hold this against the definition."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("x"))
    both = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("x").alias("y")), "p_partkey")
    return both.select("p_partkey", F.round(S.sequence_ratio(T.norm_upper(F.col("x")), T.norm_upper(F.col("y"))), 6).alias("ratio"), F.round(S.text_similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


@query(f"""WITH w AS (SELECT DISTINCT unnest(string_split({CLEAN}, ' ')) AS text FROM documents) SELECT text AS token, CASE
  WHEN text <> '' AND NOT regexp_matches(text, '{T.MONEY}') AND CASE WHEN regexp_matches(upper(replace(text, 'ß', 'SS')), '[A-ZÀ-Ý]') THEN regexp_matches(upper(replace(text, 'ß', 'SS')), '^[A-ZÀ-Ý0-9._/\\-]+$') ELSE regexp_matches(text, '^\\d+[/-]\\d+([/-]\\d+)?$') OR regexp_matches(text, '^\\d{{4,}}$') END THEN 'code'
  WHEN regexp_matches(text, '{T.MONEY}') THEN 'number' ELSE 'text' END AS class FROM w""")
def token_classify(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(clean(F.col("text")), " ")).alias("token")).distinct()
    return words.select("token", T.token_class(F.col("token")).alias("class"))


#: Texts of rows with one of the defects that the classifiers look for.
_DEFECT_SQL = f"""SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, CASE (l_orderkey + l_linenumber) % 9
  WHEN 0 THEN '- ' || d WHEN 1 THEN d || ' LS => 4,22' WHEN 2 THEN d || ' AF_02/2023 ' || d || ' AF_06/2022' WHEN 3 THEN d || ' COM ENCARGOS COMPLEMENTARES LIVRO DE CALCULOS E PARAMETROS'
  WHEN 4 THEN d || ' MATERIAL MATERIAL' WHEN 5 THEN '1,00 2,00 3,00 4,00 5,00' WHEN 6 THEN d || ' PARA' WHEN 7 THEN '' ELSE d || ' COM ENCARGOS COMPLEMENTARES HORISTA' END AS text
  FROM (SELECT *, 'SERVENTE ' || upper(p_name) || ' TIPO ' || p_type AS d FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_KEYS = ["l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice"]


def defects(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "lineitem").select(*_KEYS)).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    d = F.concat(F.lit("SERVENTE "), F.upper("p_name"), F.lit(" TIPO "), F.col("p_type"))
    kinds = [
        F.concat(F.lit("- "), d), F.concat(d, F.lit(" LS => 4,22")), F.concat(d, F.lit(" AF_02/2023 "), d, F.lit(" AF_06/2022")), F.concat(d, F.lit(" COM ENCARGOS COMPLEMENTARES LIVRO DE CALCULOS E PARAMETROS")),
        F.concat(d, F.lit(" MATERIAL MATERIAL")), F.lit("1,00 2,00 3,00 4,00 5,00"), F.concat(d, F.lit(" PARA")), F.lit(""), F.concat(d, F.lit(" COM ENCARGOS COMPLEMENTARES HORISTA")),
    ]
    return rows.select(*_KEYS, F.element_at(F.array(*kinds), ((F.col("l_orderkey") + F.col("l_linenumber")) % 9 + 1).cast("int")).alias("text"))


@query(f"""SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, CASE (l_orderkey + l_linenumber) % 9 WHEN 0 THEN 'leading_orphan_fragment' WHEN 1 THEN 'arrow_marker' WHEN 2 THEN 'multiple_service_anchors' WHEN 3 THEN 'suspicious_suffix_after_confirmed_service' ELSE '' END AS reason FROM ({_DEFECT_SQL})""")
def public_text_issue(spark, sf_dir):
    return defects(spark, sf_dir).select(*_KEYS, T.public_issue(F.col("text")).alias("reason"))


@query(f"""SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, CASE (l_orderkey + l_linenumber) % 9 WHEN 1 THEN 'pollution_term:LS =>' WHEN 3 THEN 'suspicious_suffix_after_encargos_complementares' WHEN 4 THEN 'repeated_category_label' WHEN 5 THEN 'long_numeric_sequence' WHEN 7 THEN 'empty_candidate' ELSE '' END AS reason FROM ({_DEFECT_SQL})""")
def pollution_reason(spark, sf_dir):
    return defects(spark, sf_dir).select(*_KEYS, T.pollution_reason(F.col("text")).alias("reason"))


_TAILS = ", ".join(f"'{w}'" for w in T.TRUNCATION_TAILS)


@query(f"""SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, text <> '' AND (list_contains([{_TAILS}], string_split({UPPER}, ' ')[-1]) OR (length({CLEAN}) < 32 AND NOT regexp_matches(text, '\\bAF_\\d{{2}}/\\d{{4}}\\b', 'i'))) AS truncated FROM ({_DEFECT_SQL})""")
def truncation_flag(spark, sf_dir):
    return defects(spark, sf_dir).select(*_KEYS, T.is_truncated(F.col("text")).alias("truncated"))


@query(f"""SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, CASE WHEN m IN (1, 3, 4, 5, 7) THEN 0 ELSE round(greatest(least(length(text) / 140.0::DOUBLE, 1.0) * 3.0 + least(len(string_split(text, ' ')) / 20.0::DOUBLE, 1.0) * 2.0
  + CASE WHEN m = 2 THEN 0.8 ELSE 0 END + CASE WHEN regexp_matches(text, '[()/\\-]') THEN 0.25 ELSE 0 END - CASE WHEN m = 6 OR (length(text) < 32 AND m <> 2) THEN 0.9 ELSE 0 END, 0), 4) END AS score FROM (SELECT *, (l_orderkey + l_linenumber) % 9 AS m FROM ({_DEFECT_SQL}))""")
def text_quality(spark, sf_dir):
    return defects(spark, sf_dir).select(*_KEYS, T.quality_score(F.col("text")).alias("score"))


@query("""SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, CASE (l_orderkey + l_linenumber) % 4 WHEN 0 THEN 'AUXILIAR' WHEN 1 THEN 'COMPOSICAO' WHEN 2 THEN 'INSUMO' ELSE '' END AS kind, CASE l_linenumber % 4 WHEN 0 THEN 'SINAPI' WHEN 1 THEN 'PRÓPRIO' WHEN 2 THEN 'SICRO' ELSE 'NOVA BASE' END AS bank FROM lineitem""")
def row_kind_and_bank(spark, sf_dir):
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % 4 + 1).cast("int"))
    kind = pick(["Composição Auxiliar 88256", "COMPOSIÇÃO 93391", "insumo 0001", "Total"], F.col("l_orderkey") + F.col("l_linenumber"))
    bank = pick(["Sinap i", "proprio", "SICRO-3", "nova base"], F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select(*_KEYS, T.row_kind(kind).alias("kind"), T.canonical_bank(bank).alias("bank"))


@query("""SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN 'orcamento_sintetico' WHEN 1 THEN 'memoria_calculo' WHEN 2 THEN 'composicoes_analiticas' WHEN 3 THEN 'cronograma_fisico_financeiro' WHEN 4 THEN 'composicao_bdi' WHEN 5 THEN 'curva_abc' WHEN 6 THEN 'composicoes_analiticas' WHEN 7 THEN 'orcamento_sintetico' WHEN 8 THEN 'declared_range_unknown_layout' ELSE 'unknown' END AS section,
  CASE o_orderkey % 10 WHEN 5 THEN 0.96 WHEN 6 THEN 0.9 WHEN 7 THEN 0.92 WHEN 8 THEN 0.62 WHEN 9 THEN 0.35 ELSE 0.98 END AS confidence, CASE o_orderkey % 10 WHEN 1 THEN 0.78 WHEN 2 THEN 0.98 WHEN 6 THEN 0.98 WHEN 3 THEN 0.35 WHEN 4 THEN 0.35 WHEN 5 THEN 0.35 WHEN 8 THEN 0.9 WHEN 9 THEN 0.55 ELSE 1.0 END AS weight, o_orderkey % 10 IN (0, 2, 6, 7, 8) AS price_allowed FROM orders""")
def section_policy(spark, sf_dir):
    pages = [
        "Anexo 1 - Orçamento Sintético", "ANEXO 2 Memória de Cálculo", "Anexo 3: Composições", "Anexo 4 Cronograma", "anexo 5 bdi", "Curva ABC", "Código Banco Descrição Und Quant Valor Unit Composição",
        "Item Código Fonte Especificações dos Serviços Custo Unitário", "sem título", "sem título",
    ]
    n = F.col("o_orderkey") % 10
    text = F.element_at(F.array(*map(F.lit, pages)), (n + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", T.section(text, n == 8).alias("s")).select("o_orderkey", "s.section", "s.confidence")
    policies = spark.createDataFrame([(a, b, d.split()) for a, b, _, d in T.SECTION_POLICIES], "section string, weight double, fields array<string>")
    prices = F.exists("fields", lambda f: f.isin("valor_unit", "custo_unitario_com_bdi"))
    return rows.join(F.broadcast(policies), "section").select("o_orderkey", "section", "confidence", "weight", prices.alias("price_allowed"))  # eight fixed rows


_PROX = f"SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, 'Insumo ' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || ' SINAPI ' || upper(p_name) || ' UN ' || {PT.format(x='l_quantity')} AS line, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS code FROM lineitem JOIN part ON l_partkey = p_partkey"


@query(f"SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, instr(line, code) > 0 AS found, contains(substr(line, 8, 8 + 12), 'BOLT') AS near FROM ({_PROX})")
def proximity_evidence(spark, sf_dir):
    line = row_texts(spark, sf_dir)
    code = F.lpad(F.col("l_partkey").cast("string"), 8, "0")
    return line.select(*_KEYS, (F.instr("line", code) > 0).alias("found"), R.near_anchor(F.col("line"), code, F.lit("BOLT"), 0, 12).alias("near"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'M' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') WHEN 1 THEN lpad(CAST(p_partkey AS VARCHAR), 7, '1') ELSE 'E' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') END AS codigo, 'SICRO' AS banco, p_partkey % 2 = 0 AS inverted, CASE p_partkey % 3 WHEN 0 THEN 'material' WHEN 1 THEN 'composicao_principal' ELSE 'equipamento' END AS class FROM part""")
def sicro_code_bank(spark, sf_dir):
    n = F.col("p_partkey")
    four = F.lpad((n % 10000).cast("string"), 4, "0")
    code = F.when(n % 3 == 0, F.concat(F.lit("M"), four)).when(n % 3 == 1, F.lpad(n.cast("string"), 7, "1")).otherwise(F.concat(F.lit("E"), four))
    turned = n % 2 == 0
    rows = table(spark, sf_dir, "part").withColumn("r", sicro.code_and_bank(F.when(turned, "SICRO3").otherwise(code), F.when(turned, code).otherwise("SICRO3")))
    return rows.select("p_partkey", "r.codigo", "r.banco", "r.inverted", sicro.code_class(F.col("r.codigo")).alias("class"))


@query("""SELECT o_orderkey, 'TUBO (PVC),2X3 CM' || CASE WHEN o_orderkey % 2 = 0 THEN ': ' ELSE '; ' END || o_orderstatus || CASE o_orderkey % 5 WHEN 0 THEN ', E=3 MM' WHEN 1 THEN ' NÃO ATÉ 2,5 M' WHEN 2 THEN ' 3 MM - PORTA DE ELETRICISTA' WHEN 3 THEN ' (A) AUXILIAR 2 M DE VÃO.' ELSE ' ATENÇÃO' END AS text FROM orders""")
def service_text(spark, sf_dir):
    k = F.col("o_orderkey")
    ends = F.array(*map(F.lit, [",E=3  MM", " NAO ATE 2 , 5 M", " 3 MM-POR TA DE ELETRI CISTA", "(A )AUXILI  AR 2 MDE VÃO .", " ATENÇÃO"]))
    raw = F.concat(F.lit("TUBO ( PVC ) ,2 X 3 CM"), F.when(k % 2 == 0, " : ").otherwise(" ; "), F.col("o_orderstatus"), F.element_at(ends, (k % 5 + 1).cast("int")))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.spaced_service_text(raw).alias("text"))


@query("""SELECT p_partkey, p_partkey % 4 <> 3 AS suspicious FROM part""")
def suspicious_end(spark, sf_dir):
    k = F.col("p_partkey")
    ends = F.element_at(F.array(*map(F.lit, [" DE", " (", " TIPO (A", " TIPO (A)"])), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.suspicious_end(F.concat("p_name", ends)).alias("suspicious"))


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN {PT.format(x="o_totalprice")} END AS total FROM orders""")
def grand_total(spark, sf_dir):
    price = N.format_ptbr(F.col("o_totalprice"))
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Total parcial R$ "), price)).otherwise(F.concat(F.lit("Valor Global 1,00 ... VALOR GERAL: R$ "), price, F.lit(" fim")))
    return table(spark, sf_dir, "orders").select("o_orderkey", R.grand_total(text).alias("total"))
