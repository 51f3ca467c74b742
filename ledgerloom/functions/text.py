"""Text normal forms, predicates and classifiers, as Columns.

Classifiers give the first reason that holds, so the order of their cases is part
of their meaning.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clean

#: Letters with marks and their plain forms.
MARKED = "ÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑáàâãäéèêëíìîïóòôõöúùûüçñ"
PLAIN = "AAAAAEEEEIIIIOOOOOUUUUCNaaaaaeeeeiiiiooooouuuucn"

#: Word lists of the domain.
TRUNCATION_TAILS = ["DE", "DA", "DO", "DAS", "DOS", "PARA", "COM", "E", "EM", "A", "O", "AO", "À", "AS"]
POLLUTION_TERMS = ["Custo Total das Atividades", "Valor com BDI", "Valor do BDI", "MO sem LS", "LS =>", "=>", "Total sem BDI", "Mão de Obra Mão de Obra"]
CATEGORY_WORDS = ["MATERIAL", "INSUMO", "COMPOSICAO", "AUXILIAR", "EQUIPAMENTO"]
SERVICE_SUFFIXES = ["HORISTA", "MENSALISTA", "DIURNO", "NOTURNO"]
SUMMARY_MARKERS = ["MO sem LS", "LS =>", "MO com LS", "Valor do BDI", "Valor com BDI"]
STOPWORDS = "DE DA DO DAS DOS E EM COM SEM PARA POR NA NO NAS NOS AF OU A O AS OS UM UMA UN UND M M2 M3 T".split()
STEM_SUFFIXES = (
    "COES CAO MENTOS MENTO DADES DADE TURAS TURA EIRAS EIRA EIROS EIRO IDADES IDADE ADORES ADOR ADORAS ADORA IZADAS IZADA IZADOS IZADO "
    "ADOS ADO ADAS ADA IDOS IDO IDAS IDA ICOS ICO ICAS ICA IVOS IVO IVAS IVA AIS AL S"
).split()
STEM_ALIASES = {
    "FABRIC": ["FABRIC", "PREFABRIC"], "MONT_INSTAL": ["MONT", "INSTAL", "FORNEC"], "TESOURA": ["TESOURA", "MEIATESOURA"], "ICAMENTO": ["ICAMENT", "GUINDAST"],
    "ASFALTO": ["ASFALT"], "EMULSAO": ["EMULS"], "IMPRIMACAO": ["IMPRIM"], "ARGILA": ["ARGIL"], "MADEIRA": ["MADEIR"], "TRANSPORTE": ["TRANSPORT"],
    "CAMINHAO": ["CAMINHA"], "BASCULANTE": ["BASCULANT"],
}
BANK_ALIASES = {
    "SINAPI": ["SINAPI", "SINAP I", "SINAP"], "PRÓPRIO": ["PRÓPRIO", "PROPRIO", "PROP", "PRÓP."], "ORSE": ["ORSE"], "SICRO": ["SICRO", "SICRO3", "SICRO 3", "SICRO-3"],
    "SEINFRA": ["SEINFRA"], "DNIT": ["DNIT"], "SEDOP": ["SEDOP"], "SBC": ["SBC"],
}
ANCHOR = r"(?i)\bAF_\d{2}/\d{4}\b"
MONEY = r"^[+-]?(\d{1,3}(\.\d{3})*|\d+),\d{1,8}%?$"


def let(c: Column, body) -> Column:
    """``body(c)`` with c worked out once, however often the body names it."""
    return F.transform(F.array(c), body)[0]


def unmarked(c: Column) -> Column:
    return F.translate(c, MARKED, PLAIN)


def norm_upper(c: Column) -> Column:
    return F.upper(unmarked(F.upper(clean(c))))


def norm_lower(c: Column) -> Column:
    """Lower case without marks; of signs only / % . are kept."""
    s = F.regexp_replace(unmarked(F.lower(F.trim(F.coalesce(c, F.lit(""))))), r"[^a-z0-9/%.\s]+", " ")
    return F.trim(F.regexp_replace(s, r"\s{2,}", " "))


def literal(s: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", s)


def any_marker(c: Column, markers: list[str]) -> Column:
    """True if the text holds one of the markers; of no markers, false."""
    return reduce(lambda a, b: a | b, [F.contains(F.coalesce(c, F.lit("")), F.lit(m)) for m in markers if m], F.lit(False))


def break_before(c: Column, markers: list[str]) -> Column:
    """A new line before each marker."""
    found = [literal(m) for m in markers if m]
    return F.regexp_replace(c, f"(?=({'|'.join(found)}))", "\n") if found else c


def cut_at_marker(c: Column, markers: list[str]) -> Column:
    """The text up to the first marker that occurs."""
    s = clean(c)
    at = [F.when(F.instr(s, F.lit(m)) > 0, F.instr(s, F.lit(m))) for m in markers if m]
    if not at:
        return s
    first = F.least(*at) if len(at) > 1 else at[0]
    return F.when(first.isNotNull(), F.trim(F.substring(s, F.lit(1), first - 1))).otherwise(s)


def lines(c: Column) -> Column:
    """The lines of a text, cleaned, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), clean), lambda x: x != "")


def sanitized_lines(c: Column, drop: list[str], strip: list[str]) -> Column:
    """Lines cut at ``strip`` markers; those that hold a ``drop`` marker, or nothing, go."""
    cut = F.transform(lines(c), lambda x: cut_at_marker(x, strip))
    return F.filter(cut, lambda x: (x != "") & ~any_marker(x, drop))


def safe_continuation(c: Column, toxic: list[str]) -> Column:
    """May a line go on with the one before it: not empty, no numbered row, no toxic marker."""
    s = clean(c)
    return (s != "") & ~s.rlike(r"^\d+(\.\d+)*\s+\S+") & ~any_marker(s, toxic)


#: Patterns of a service's text and what stands in their place, in order.
SERVICE_RULES = (
    (r",(?=[A-ZÀ-Ú])", ", "),
    (r"\)(?=[A-ZÀ-Ú])", ") "),
    (r"(?<=[A-ZÀ-Ú])\((?=[A-ZÀ-Ú])", " ("),
    (r"(?<=[A-ZÀ-Ú]),\s*E=", ", E="),
    (r"(?<![\p{L}\p{N}_])NAO(?![\p{L}\p{N}_])", "NÃO"),
    (r"(?<![\p{L}\p{N}_])ATE(?![\p{L}\p{N}_])", "ATÉ"),
    (r"(?<=\d)\s*,\s*(?=\d)", ","),
    (r"\s+,", ","),
    (r"\(\s+", "("),
    (r"\s+\)", ")"),
    (r"\s+([;:.])", "$1"),
    (r"(\d+)\s+X\s+(\d+)\s+(CM|MM|M)\b", "$1X$2 $3"),
    (r"(?<=\b\d\s(?:MM|CM))-(?=[A-ZÀ-Ú])", " - "),
    (r"(?i)(?<![\p{L}\p{N}_])(M)DE\s*V([AÃã])O(?![\p{L}\p{N}_])", "$1 DE V$2O"),
    (r"(?i)\bPOR\s+TA\b", "PORTA"),
    (r"(?i)\bELETRI\s+CISTA\b", "ELETRICISTA"),
    (r"(?i)\bAUXILI\s+AR\b", "AUXILIAR"),
    (r"\s{2,}", " "),
)


def spaced_service_text(c: Column) -> Column:
    """Spaces put right around commas, brackets, stops and dimensions, and words that print often breaks."""
    return F.trim(reduce(lambda s, rule: F.regexp_replace(s, *rule), SERVICE_RULES, clean(c)))


def split_glued(c: Column) -> Column:
    """Spaces where long upper-case words and numbers run into one another."""
    s = F.regexp_replace(clean(c), r"(?<=[A-ZÀ-Ú]{3})(?=\d)", " ")
    return F.regexp_replace(s, r"(?<=\d)(?=[A-ZÀ-Ú]{4})", " ")


def without_terms(c: Column, terms: list[str]) -> Column:
    """The text without the given terms, whatever their case."""
    found = [literal(t) for t in terms if t]
    return clean(F.regexp_replace(c, "(?i)" + "|".join(found), " ")) if found else clean(c)


def is_money(c: Column) -> Column:
    """Clear only with a comma and decimals: a bare integer may be a code."""
    return F.replace(clean(c), F.lit(" "), F.lit("")).rlike(MONEY)


def is_code(c: Column) -> Column:
    """Letters with digits, dots, dashes, slashes; n/n; or four digits and more.  Never money."""
    s = F.regexp_replace(F.upper(clean(c)), r"\s+", "")
    lettered = s.rlike("[A-ZÀ-Ý]")
    return (s != "") & ~is_money(c) & F.when(lettered, s.rlike(r"^[A-ZÀ-Ý0-9._/\-]+$")).otherwise(s.rlike(r"^\d+[/-]\d+([/-]\d+)?$") | s.rlike(r"^\d{4,}$"))


NUMERIC_CONTEXTS = ["VALOR", "VALOR_UNIT", "TOTAL", "QUANT", "QUANTIDADE", "CUSTO", "PRECO"]


def token_class(c: Column, context: Column | None = None) -> Column:
    """number, code or text; a number column makes money of what could be a code."""
    ctx = norm_upper(context) if context is not None else F.lit("")
    return F.when(ctx.isin(NUMERIC_CONTEXTS) & is_money(c), "number").when(is_code(c), "code").when(is_money(c), "number").otherwise("text")


def row_kind(c: Column) -> Column:
    """AUXILIAR before INSUMO before COMPOSICAO, by how the text begins."""
    s = F.replace(norm_lower(c), F.lit(" "), F.lit(""))
    return F.when(s.startswith("composicaoauxiliar") | s.startswith("auxiliar"), "AUXILIAR").when(s.startswith("insumo"), "INSUMO").when(s.startswith("composicao"), "COMPOSICAO").otherwise("")


def _after(c: Column, marker: str) -> Column:
    at = F.instr(c, F.lit(marker))
    return F.when(at > 0, F.trim(F.regexp_replace(F.substring(c, at + len(marker), F.length(c)), r"^[ \-:.;]+|[ \-:.;]+$", "")))


def suspicious_suffix(c: Column) -> Column:
    """Three words or more after the end of a known service: a heading stuck to it."""
    marker = "COM ENCARGOS COMPLEMENTARES"
    rest = let(norm_upper(c), lambda upper: _after(upper, marker))
    return let(rest, lambda r: F.coalesce((r != "") & (F.size(F.split(r, r"\s+")) >= 3), F.lit(False)))


def concatenated_categories(c: Column) -> Column:
    """Many separators, or many short titles in a long text, and hardly a service anchor."""
    raw = clean(c)
    count = lambda s: F.size(F.split(raw, literal(s))) - 1
    anchors = F.regexp_count(raw, F.lit(ANCHOR))
    chunks = F.split(raw, r"\s{2,}|\s+-\s+|;|\|")
    words = lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    titles = F.size(F.filter(chunks, lambda x: words(x).between(2, 6) & ~x.rlike(r"\d")))
    return ((count(" - ") + count("; ") + count(" | ") >= 4) & (anchors <= 1)) | ((F.length(raw) >= 160) & (titles >= 5) & (anchors == 0))


def pollution_reason(c: Column) -> Column:
    """Why a text can be no description; empty if it can."""
    repeated = "|".join(rf"\b{w}\b(\s+\b{w}\b)+" for w in CATEGORY_WORDS)

    def reason(raw: Column, upper: Column) -> Column:
        out = F.when(raw == "", "empty_candidate").when(suspicious_suffix(raw), "suspicious_suffix_after_encargos_complementares").when(concatenated_categories(raw), "concatenated_category_text")
        for term in POLLUTION_TERMS:
            out = out.when(F.contains(upper, F.lit(_plain_upper(term))), f"pollution_term:{term}")
        return (
            out.when(upper.rlike(repeated), "repeated_category_label")
            .when(F.regexp_count(raw, F.lit(r"(?<![A-Z0-9])\d{1,3}(\.\d{3})*,\d{2,7}(?![A-Z0-9])")) >= 4, "long_numeric_sequence")
            .when(raw.rlike(r"^[\d\s.,%/\-]+$"), "numeric_only_text")
            .when((F.length(raw) > 300) & ~F.contains(F.upper(raw), F.lit("AF_")), "candidate_too_long_without_service_anchor")
            .otherwise("")
        )

    return let(clean(c), lambda raw: let(F.upper(unmarked(F.upper(raw))), lambda upper: reason(raw, upper)))


def _plain_upper(s: str) -> str:
    return s.upper().translate(str.maketrans(MARKED, PLAIN)).upper()


def is_truncated(c: Column) -> Column:
    """Ends in a connecting word, or is short and has no service anchor."""
    raw = clean(c)
    return (raw != "") & (F.element_at(F.split(norm_upper(raw), " "), -1).isin(TRUNCATION_TAILS) | ((F.length(raw) < 32) & ~raw.rlike(ANCHOR)))


def quality_score(c: Column) -> Column:
    """How much a text looks like a whole description; 0 for polluted ones."""

    def score(raw: Column) -> Column:
        points = (
            F.least(F.length(raw) / 140.0, F.lit(1.0)) * 3.0
            + F.least(F.size(F.split(raw, " ")) / 20.0, F.lit(1.0)) * 2.0
            + F.when(raw.rlike(ANCHOR), 0.8).otherwise(0.0)
            + F.when(raw.rlike(r"[()/\-]"), 0.25).otherwise(0.0)
            - F.when(is_truncated(raw), 0.9).otherwise(0.0)
            - F.when(is_money(raw), 3.0).otherwise(0.0)
        )
        return F.when((raw == "") | (pollution_reason(raw) != ""), F.lit(0.0)).otherwise(F.round(F.greatest(points, F.lit(0.0)), 4))

    return let(clean(c), score)


def public_issue(c: Column) -> Column:
    """Why a public text must be looked at; empty if it need not."""
    text = clean(c)
    rest = _after(F.upper(text), "COM ENCARGOS COMPLEMENTARES")
    words = F.filter(F.split(rest, r"\s+"), lambda x: x != "")
    allowed = (F.size(words) <= 2) & (F.size(F.array_except(words, F.array(*map(F.lit, SERVICE_SUFFIXES)))) == 0)
    return (
        F.when(text == "", "")
        .when(F.contains(text, F.lit("=>")), "arrow_marker")
        .when(text.startswith("-"), "leading_orphan_fragment")
        .when(F.regexp_count(text, F.lit(ANCHOR)) >= 2, "multiple_service_anchors")
        .when(F.coalesce(text.rlike(r"(?i)\bCOM ENCARGOS COMPLEMENTARES\s+\w+\s+\w+\s+\w+") & (F.size(words) > 0) & ~allowed, F.lit(False)), "suspicious_suffix_after_confirmed_service")
        .otherwise("")
    )


def suspicious_end(c: Column) -> Column:
    """Ends in a connecting word, an open bracket or a dangling sign."""
    s = norm_upper(c)
    return (s != "") & (F.element_at(F.split(s, " "), -1).isin(TRUNCATION_TAILS) | s.rlike(r"[(\[,;:\-/]$") | (F.size(F.split(s, r"\(")) > F.size(F.split(s, r"\)"))))


def is_summary_row(*parts: Column) -> Column:
    """A line that sums others up, and must not be summed itself."""
    hay = unmarked(F.lower(clean(F.concat_ws(" ", *parts))))
    return any_marker(hay, [m.lower().translate(str.maketrans(MARKED, PLAIN)) for m in SUMMARY_MARKERS])


def tokens(c: Column) -> Column:
    """Upper-case words of two letters or digits and more, without stop words."""
    found = F.regexp_extract_all(norm_upper(c), F.lit(r"([A-Z0-9]+)"), F.lit(1))
    return F.array_except(F.filter(F.array_distinct(found), lambda x: F.length(x) > 1), F.array(*map(F.lit, STOPWORDS)))


def stem(c: Column) -> Column:
    """The word without the first listed suffix that leaves four letters, and without PRE."""
    def cut(s: Column) -> Column:
        out = F
        for suffix in STEM_SUFFIXES:
            out = out.when((F.length(s) - len(suffix) >= 4) & s.endswith(suffix), F.substring(s, F.lit(1), F.length(s) - len(suffix)))
        return out.otherwise(s)

    def without_pre(s: Column) -> Column:
        return F.when(s.startswith("PRE") & (F.length(s) > 7), F.substring(s, F.lit(4), F.length(s))).otherwise(s)

    return let(F.regexp_replace(norm_upper(c), "[^A-Z0-9]", ""), lambda s: F.when(s.isin(["", *STOPWORDS]), "").otherwise(let(cut(s), without_pre)))


def semantic_tokens(c: Column) -> Column:
    """Stems of the words and the groups they belong to."""
    begins = lambda stems, variants: F.exists(stems, lambda x: reduce(lambda a, b: a | b, [x.startswith(p) for p in variants]))
    groups = lambda stems: F.array_compact(F.array(*[F.when(begins(stems, variants), F.lit(name)) for name, variants in STEM_ALIASES.items()]))
    return let(F.filter(F.transform(tokens(c), stem), lambda x: x != ""), lambda stems: F.array_distinct(F.concat(stems, groups(stems))))


def canonical_bank(c: Column) -> Column:
    """The main name of a price bank; spaces and marks do not matter, unknown names in upper case."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    key = F.replace(norm_lower(raw), F.lit(" "), F.lit(""))
    out = None
    for name, aliases in BANK_ALIASES.items():
        keys = sorted({re.sub(r"[^a-z0-9/%.]", "", _plain_upper(a).lower()) for a in aliases})
        out = F.when(key.isin(keys), name) if out is None else out.when(key.isin(keys), name)
    return F.when(raw == "", "").otherwise(out.otherwise(F.upper(raw)))


def norm_code(c: Column) -> Column:
    return F.replace(F.upper(clean(c)), F.lit(" "), F.lit(""))


def code_key(code: Column, bank: Column) -> Column:
    """CODE|BANK, the identity of a composition; empty if either is missing."""
    c, b = norm_code(code), canonical_bank(bank)
    return F.when((c != "") & (b != ""), F.concat(c, F.lit("|"), b)).otherwise("")


#: Sections of a document: name, confidence, groups of words of which each must be there in one form.
SECTIONS = [
    ("orcamento_sintetico", 0.98, [["ANEXO 1"], ["ORCAMENTO SINTETICO"]]),
    ("memoria_calculo", 0.98, [["ANEXO 2"], ["MEMORIA DE CALCULO"]]),
    ("composicoes_analiticas", 0.98, [["ANEXO 3"], ["COMPOSICOES", "COMPOSICAO"]]),
    ("cronograma_fisico_financeiro", 0.98, [["ANEXO 4"], ["CRONOGRAMA"]]),
    ("composicao_bdi", 0.98, [["ANEXO 5"], ["BDI"]]),
    ("curva_abc", 0.96, [["CURVA ABC", "ANEXO 7"]]),
    ("composicoes_analiticas", 0.90, [["CODIGO BANCO DESCRICAO UND QUANT"], ["VALOR UNIT"], ["COMPOSICAO"]]),
    ("orcamento_sintetico", 0.92, [["ITEM CODIGO FONTE ESPECIFICACOES DOS SERVICOS"], ["CUSTO UNITARIO"]]),
]
#: What evidence from a section is worth, how it may be used, and the fields it may fill.
SECTION_POLICIES = [
    ("orcamento_sintetico", 1.00, "budget_fields_authoritative", "custo_parcial custo_total custo_unitario_com_bdi custo_unitario_sem_bdi descricao especificacao quant und"),
    ("composicoes_analiticas", 0.98, "composition_fields_authoritative", "descricao especificacao quant total und valor_unit"),
    ("memoria_calculo", 0.78, "quantity_and_context_only", "descricao especificacao quant und"),
    ("curva_abc", 0.35, "diagnostic_context_only", ""),
    ("cronograma_fisico_financeiro", 0.35, "diagnostic_context_only", ""),
    ("composicao_bdi", 0.35, "diagnostic_context_only", ""),
    ("declared_range_unknown_layout", 0.90, "declared_range_structured_fallback", "custo_parcial custo_total custo_unitario_com_bdi custo_unitario_sem_bdi descricao especificacao quant total und valor_unit"),
    ("unknown", 0.55, "raw_context_only", "descricao especificacao und"),
]


def section(c: Column, in_range: Column | None = None) -> Column:
    """name and confidence of the document section that a page is in."""
    text = norm_upper(c)
    hit = lambda groups: reduce(lambda a, b: a & b, [any_marker(text, g) for g in groups])
    give = lambda name, conf: F.struct(F.lit(name).alias("section"), F.lit(conf).alias("confidence"))
    out = None
    for name, conf, groups in SECTIONS:
        out = F.when(hit(groups), give(name, conf)) if out is None else out.when(hit(groups), give(name, conf))
    if in_range is not None:
        out = out.when(in_range, give("declared_range_unknown_layout", 0.62))
    return out.otherwise(give("unknown", 0.35))
