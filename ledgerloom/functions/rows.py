"""Reading budget and composition rows out of one line of text, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clean
from .text import let, literal

#: Fixed value: a number with a decimal comma, as rows end in.
NUMBER = r"\d{1,3}(?:\.\d{3})*,\d{1,8}|\d+,\d{1,8}"
#: unit, quantity, unit price, total.
TAIL = rf"(?<![^\s])([A-Za-z%][A-Za-z0-9²³%/]{{0,7}})\s+({NUMBER})\s+({NUMBER})\s+({NUMBER})(?![^\s])"
KIND = r"(?i)^\s*(Composi[cç][aã]o Auxiliar|Composi[cç][aã]o|Insumo|Auxiliar|Atividade Auxiliar|Tempo Fixo)\b"
BANKS = r"SINAPI|SICRO\d?|PR[ÓO]PRIO|ORSE|SEINFRA|DNIT|SEDOP|SBC|ANP"
BANK = rf"(?i)\b({BANKS})\b"
CODE = r"[A-Z]{0,6}[.\-]?\d{4,8}(?:/\d{1,4})?|[A-Z]{2,6}[.\-][A-Z0-9.\-]+|[A-Z]\d{4}"
UNIT_BLACKLIST = ["DE", "DA", "DO", "E", "COM", "EM", "PARA", "A", "O"]


def _tail_struct(text: Column) -> Column:
    """A matched tail as its four tokens."""
    part = lambda i: F.regexp_extract(text, rf"^{TAIL}$", i)
    return F.struct(part(1).alias("und"), part(2).alias("quant"), part(3).alias("valor_unit"), part(4).alias("total"))


def all_tails(c: Column) -> Column:
    """Every unit with three numbers, in order; words that join others are no units."""
    found = F.regexp_extract_all(clean(c), F.lit(f"({TAIL})"), F.lit(1))
    return F.filter(F.transform(found, _tail_struct), lambda t: ~F.upper(t["und"]).isin(UNIT_BLACKLIST))


def numeric_tail(c: Column) -> Column:
    """The last unit with three numbers in a row's text, or null.  Only tokens that are there are ever given."""
    return F.try_element_at(all_tails(c), F.lit(-1))


def expected_tail(c: Column, expected: Column) -> Column:
    """The tail whose total is the expected one, or else the last; arithmetic selects and never writes."""
    tails = all_tails(c)
    wanted = F.filter(tails, lambda t: t["total"] == expected)
    return F.when(expected.isNotNull() & (F.size(wanted) > 0), F.element_at(wanted, -1)).when(F.size(tails) > 0, F.element_at(tails, -1))


def tail_status(c: Column) -> Column:
    """consistent if the first and the last tail agree, ambiguous if not, missing if there is none."""
    status = lambda t: F.when(F.size(t) == 0, "missing").when(F.try_element_at(t, F.lit(1)) == F.try_element_at(t, F.lit(-1)), "consistent").otherwise("ambiguous")
    return let(all_tails(c), status)


def parse_row(c: Column) -> Column:
    """kind, code, bank, description and tail of a row: the code stands before the bank, the description between the two and the tail."""
    return let(clean(c), lambda s: let(numeric_tail(s), lambda tail: _parsed(s, tail)))


def _parsed(s: Column, tail: Column) -> Column:
    return let(F.upper(F.regexp_extract(s, BANK, 1)), lambda bank: _parts(s, tail, bank))


def _parts(s: Column, tail: Column, bank: Column) -> Column:
    kind = F.regexp_extract(s, KIND, 1)
    head = F.when(bank != "", F.regexp_extract(s, rf"(?i)^(.*?)\b(?:{BANKS})\b", 1)).otherwise(s)
    codes = F.regexp_extract_all(F.upper(head), F.lit(rf"(?<![A-Z0-9])({CODE})(?![A-Z0-9])"), F.lit(1))
    code = F.coalesce(F.try_element_at(codes, F.lit(-1)), F.lit(""))
    whole = F.concat_ws(" ", tail["und"], tail["quant"], tail["valor_unit"], tail["total"])
    body = F.when(tail.isNotNull(), F.substring(s, F.lit(1), F.greatest(F.instr(s, whole) - 1, F.lit(0)))).otherwise(s)
    after_bank = F.regexp_replace(body, rf"(?i)^.*?\b(?:{BANKS})\b", "")
    description = F.trim(F.when(bank != "", after_bank).otherwise(F.regexp_replace(body, KIND, "")))
    return F.struct(
        kind.alias("kind"), code.alias("codigo"), F.regexp_replace(bank, r"^SICRO\d?$", "SICRO").alias("banco"), description.alias("descricao"),
        tail["und"].alias("und"), tail["quant"].alias("quant"), tail["valor_unit"].alias("valor_unit"), tail["total"].alias("total"),
    )


def tolerant_pattern(token: Column) -> Column:
    """A pattern for a printed number in which spaces may stand around stops and commas."""
    return F.regexp_replace(F.regexp_replace(token, r"\.", r"\\s*\\.\\s*"), ",", r"\\s*,\\s*")


def near_anchor(text: Column, anchor: Column, token: Column, before: int, after: int) -> Column:
    """Does the token stand within so many characters before or after the first anchor."""
    at = F.instr(text, anchor)
    start = F.greatest(at - before, F.lit(1))
    window = F.substring(text, start, at - start + F.length(anchor) + after)
    return (at > 0) & F.contains(window, token)


def segment_of(text: Column, code: str, bank: str) -> Column:
    """The text of a row inside its block: from its code and bank to the next row, header or sum."""
    stop = r"(?=\s(?:Composi[cç][aã]o Auxiliar|Composi[cç][aã]o|Insumo)\s|\s\d+(?:\.\d+)*\s+C[ÓO]DIGO|\sMO sem LS|\sValor do BDI|$)"
    return F.regexp_extract(clean(text), rf"(?i)({literal(code)}\s+{literal(bank)}\b.*?){stop}", 1)


def words_around(text: Column, word: Column, n: int) -> Column:
    """The n words before and after the first place of a word."""
    words = F.split(clean(text), " ")
    at = F.array_position(words, word).cast("int")
    return F.when(at > 0, F.slice(words, F.greatest(at - n, F.lit(1)), F.lit(2 * n + 1)))


def grand_total(c: Column) -> Column:
    """The amount printed behind the last mention of a grand total, as text; null if there is none."""
    found = F.regexp_extract_all(clean(c), F.lit(rf"(?i)\b(?:valor|total)\s+(?:geral|global)\b[^0-9]{{0,20}}({NUMBER})"), F.lit(1))
    return F.try_element_at(found, F.lit(-1))
