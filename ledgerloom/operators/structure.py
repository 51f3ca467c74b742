"""What the columns of a table are: from headers, positions and contents."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import sequence_ratio
from ..functions.text import is_code, is_money, norm_lower

#: Names by which the columns of a composition table go.
HEADERS = {
    "codigo": ["codigo", "cod", "código"], "banco": ["banco", "fonte", "base"], "descricao": ["descricao", "especificacao", "discriminacao"], "und": ["und", "un", "unid", "unidade"],
    "quant": ["quant", "quant.", "quantidade", "qtd"], "valor_unit": ["valor unit", "valor unitario", "preco unitario", "custo unitario"], "total": ["total", "valor total", "custo total"],
}


def header_map(cells: DataFrame, table: str = "table_id", index: str = "col_index", text: str = "text", aliases: dict[str, list[str]] | None = None, min_similarity: float | None = 0.88) -> DataFrame:
    """The column of each canonical name: an exact alias first, then the longest alias that is a whole phrase in the header, then the most like one.

    Aliases of one or two letters only match exactly.  Likeness is looked at for
    headers that nothing else names, if at all (``min_similarity``).  Each header names one column,
    and of several headers of a name the first column counts.
    """
    spark = cells.sparkSession
    rows = [(name, i, a) for i, (name, names) in enumerate((aliases or HEADERS).items()) for a in names]
    known = spark.createDataFrame(rows, "canonical string, ord int, alias string").withColumn("alias", norm_lower(F.col("alias"))).distinct()
    heads = cells.select(table, index, norm_lower(F.col(text)).alias("head")).where("head <> ''")
    # the aliases are a fixed list; each header meets all of them
    pairs = heads.join(F.broadcast(known), F.contains(F.concat(F.lit(" "), F.col("head")), F.substring("alias", 1, 1)))
    plain = lambda c: F.concat(F.lit(" "), F.regexp_replace(c, r"[^a-z0-9]+", " "), F.lit(" "))
    phrase = (F.length(F.replace(F.col("alias"), F.lit(" "), F.lit(""))) > 2) & F.contains(plain(F.col("head")), F.concat(F.lit(" "), F.trim(plain(F.col("alias"))), F.lit(" ")))
    tier = F.when(F.col("head") == F.col("alias"), 0).when(phrase, 1)
    scored = pairs.withColumn("tier", tier).where("tier is not null")
    best = scored.groupBy(table, index).agg(F.min_by("canonical", F.struct("tier", -F.length("alias"), "ord")).alias("canonical"))
    if min_similarity is not None:
        rest = heads.join(best, [table, index], "left_anti").select("head").distinct()
        like = rest.join(F.broadcast(known)).withColumn("ratio", sequence_ratio("head", "alias")).where(F.col("ratio") >= min_similarity)
        like = like.groupBy("head").agg(F.max_by("canonical", F.struct("ratio", -F.col("ord"))).alias("canonical"))
        best = best.unionByName(heads.join(best, [table, index], "left_anti").join(like, "head").select(table, index, "canonical"))
    return best.groupBy(table, "canonical").agg(F.min(index).alias(index))


def missing_columns(mapped: DataFrame, table: str, required: list[str]) -> DataFrame:
    have = mapped.groupBy(table).agg(F.collect_set("canonical").alias("have"))
    return have.select(table, F.array_sort(F.array_except(F.array(*map(F.lit, required)), "have")).alias("missing"))


def is_header(mapped: DataFrame, table: str, required: list[str], min_hits: int = 3) -> DataFrame:
    """Tables whose header names all required columns, or enough of any."""
    have = mapped.groupBy(table).agg(F.collect_set("canonical").alias("have"))
    return have.select(table, ((F.size(F.array_except(F.array(*map(F.lit, required)), "have")) == 0) | (F.size("have") >= min_hits)).alias("is_header"))


def band_bounds(columns: DataFrame, table: str, x0: str = "x0", last: float = 1e9) -> DataFrame:
    """Each column from its x0 to the next one's."""
    w = Window.partitionBy(table).orderBy(x0)
    return columns.withColumn("bound", F.coalesce(F.lead(x0).over(w), F.lit(float(last))))


def midpoint_bands(columns: DataFrame, table: str) -> DataFrame:
    """Bands that meet half way between neighbours."""
    w = Window.partitionBy(table).orderBy("x0", "x1")
    left, right = F.lag("x1").over(w), F.lead("x0").over(w)
    return columns.withColumns({"left": F.least(F.coalesce((left + F.col("x0")) / 2, F.col("x0")), F.col("x0")), "right": F.greatest(F.coalesce((F.col("x1") + right) / 2, F.col("x1")), F.col("x1"))})


def assign_bands(words: DataFrame, bands: DataFrame, table: str, word_id: str, tolerance: float = 4.0) -> DataFrame:
    """The band whose span, widened by the tolerance, holds a word's centre: the nearest, then the narrowest."""
    b = bands.select(table, "canonical", F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    centre = (F.col("x0") + F.col("x1")) / 2
    pairs = words.withColumn("centre", centre).join(b, table).where((F.col("centre") >= F.col("b0") - tolerance) & (F.col("centre") <= F.col("b1") + tolerance))
    best = F.struct(F.abs(F.col("centre") - (F.col("b0") + F.col("b1")) / 2), F.col("b1") - F.col("b0"), F.col("canonical"))
    return pairs.groupBy(table, word_id).agg(F.min_by("canonical", best).alias("canonical"))


def learned_bands(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The median span of each field, where an observation counts as often as it weighs (1 to 4)."""
    rows = spans.withColumn("again", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(4), F.col("weight").cast("int"))))))
    return rows.groupBy(*keys).agg(F.median("x0").alias("x0"), F.median("x1").alias("x1"), F.count(F.lit(1)).alias("n"))


def blend_bands(seed: DataFrame, learned: DataFrame, keys: list[str]) -> DataFrame:
    """The middle of seed and learned bounds; adjusted if the seed was off by more than 2."""
    a, b = seed.select(*keys, F.col("x0").alias("a0"), F.col("x1").alias("a1")), learned.select(*keys, F.col("x0").alias("c0"), F.col("x1").alias("c1"))
    mid = lambda x, y: F.coalesce((F.col(x) + F.col(y)) / 2, F.col(x), F.col(y))
    off = F.coalesce((F.abs(F.col("a0") - F.col("c0")) > 2) | (F.abs(F.col("a1") - F.col("c1")) > 2), F.lit(False))
    both = F.col("a0").isNotNull() & F.col("c0").isNotNull()
    return a.join(b, keys, "full_outer").select(*keys, mid("a0", "c0").alias("x0"), mid("a1", "c1").alias("x1"), off.alias("adjusted"), F.when(both & ~off, 0.08).when(both, 0.04).otherwise(0.0).alias("gain"))


def column_roles(cells: DataFrame, table: str = "table_id", index: str = "col_index", text: str = "text", least: float = 0.42) -> DataFrame:
    """What each column holds, by shares of its cells: code, bank, unit, money or text; unknown below ``least``.

    Of several columns taken for code, bank or unit only the surest keeps the role.
    """
    t = F.trim(F.col(text))
    share = lambda cond: F.avg(cond.cast("double"))
    stats = cells.where(t != "").groupBy(table, index).agg(
        share(is_code(t) & t.rlike(r"\d")).alias("codigo"), share(F.upper(t).rlike(r"^(SINAPI|SICRO\d?|PR[ÓO]PRIO|ORSE|SBC|ANP)$")).alias("banco"),
        share(F.upper(t).rlike(r"^(UN|UND|UNID|M|M2|M3|M²|M³|KG|H|T|L|MES|%)$")).alias("und"), share(is_money(t)).alias("numero"), share((F.length(t) >= 12) & t.rlike("[A-Za-z]{3}")).alias("descricao"),
    )
    roles = ["codigo", "banco", "und", "numero", "descricao"]
    best = F.array_max(F.array(*[F.struct(F.col(r).alias("share"), F.lit(-i).alias("ord"), F.lit(r).alias("role")) for i, r in enumerate(roles)]))
    stats = stats.withColumn("best", best).select(table, index, F.when(F.col("best.share") >= least, F.col("best.role")).otherwise("unknown").alias("role"), F.round("best.share", 6).alias("share"))
    w = Window.partitionBy(table, "role").orderBy(F.col("share").desc(), index)
    single = F.col("role").isin("codigo", "banco", "und") & (F.row_number().over(w) > 1)
    return stats.withColumn("again", single).withColumn("role", F.when(F.col("again"), "unknown").otherwise(F.col("role"))).drop("again")


def closing_order(numbers: Column, tolerance: float = 0.01) -> Column:
    """The order in which three numbers close q * u = t, as quantity, price and total; the smallest difference wins, null if none closes."""
    options = [F.struct(F.abs(numbers[i] * numbers[j] - numbers[k]).alias("delta"), F.lit(n).alias("ord"), numbers[i].alias("q"), numbers[j].alias("u"), numbers[k].alias("t")) for n, (i, j, k) in enumerate(permutations(range(3)))]
    best = F.array_min(F.array(*options))
    return F.when(best["delta"] <= tolerance, F.struct(best["q"].alias("q"), best["u"].alias("u"), best["t"].alias("t"), best["delta"].alias("delta")))
