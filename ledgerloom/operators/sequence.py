"""Operators over ordered lines: clusters, blocks, sessions, neighbours, bounded scans.

What a lag or a running sum can express is a window over one document.  Rules that
depend on what was accepted before run as Python over one document or page.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "block") -> DataFrame:
    """Numbers the runs of rows that begin where ``starts`` holds; rows before the first have number 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def stitch(df: DataFrame, keys: list[str], order: str, same: list[str], step: int = 1) -> DataFrame:
    """Sessions of rows next to each other that agree on ``same``."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(F.struct(order, *same)).over(w)
    goes_on = (F.col(order) - before[order] <= step) & F.struct(*same).eqNullSafe(F.struct(*[before[c].alias(c) for c in same]))
    return islands(df.withColumn("starts", ~F.coalesce(goes_on, F.lit(False))), keys, [order], F.col("starts"), "segment").drop("starts")


def neighbours(df: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({f"prev_{column}": F.lag(column).over(w), f"next_{column}": F.lead(column).over(w)})


def dilate(df: DataFrame, keys: list[str], order: str, flag: str, radius: int) -> DataFrame:
    """Rows whose flag, or that of one at most ``radius`` rows away, is set."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-radius, radius)
    return df.withColumn("near", F.max(F.col(flag).cast("int")).over(w) == 1)


def systematic_sample(df: DataFrame, keys: list[str], order: str, k: int) -> DataFrame:
    """At most k rows of each group at even distances, first and last among them; a fixed number is the point of it."""
    w = Window.partitionBy(*keys)
    rows = df.withColumns({"place": F.row_number().over(w.orderBy(order)) - 1, "last": F.count(F.lit(1)).over(w) - 1})
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(F.col("last") * i / F.lit(float(max(1, k - 1)))).cast("long"))
    return rows.where((F.col("last") < k) | F.array_contains(picks, F.col("place").cast("long"))).drop("place", "last")


def gap_profile(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Median gap between rows (the upper of two middle ones), the gap up to which a line goes on, and from which an item begins."""
    w = Window.partitionBy(*keys).orderBy(order)
    gaps = df.withColumn("gap", F.col(order) - F.lag(order).over(w)).where("gap > 0")
    places = Window.partitionBy(*keys)
    ranked = gaps.withColumns({"place": F.row_number().over(places.orderBy("gap")) - 1, "n": F.count(F.lit(1)).over(places)})
    middle = ranked.where(F.col("place") == F.floor(F.col("n") / 2)).select(*keys, F.col("gap").alias("median_gap"), "n")
    return middle.withColumns({"continuation_max_gap": F.round(F.col("median_gap") * 1.45, 4), "item_gap_min": F.round(F.col("median_gap") * 1.75, 4)})


def continuations(df: DataFrame, keys: list[str], order: list[str], is_row: Column, text: str) -> DataFrame:
    """Rows with the texts of the fragments that follow them joined on; fragments before the first row stand alone."""
    numbered = islands(df.withColumn("is_row", is_row), keys, order, F.col("is_row"), "row_no")
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text))))
    out = numbered.groupBy(*keys, "row_no").agg(parts.alias("parts"))
    return out.select(*keys, "row_no", F.array_join(F.transform("parts", lambda p: p[text]), " ").alias(text), F.size("parts").alias("n_parts"))


def blocks(rows: DataFrame, doc: str, order: list[str], kind: str = "kind", key: str = "key") -> DataFrame:
    """Lines into blocks: a principal row with another key than the one before closes its block; lines before any are orphans (block 0).

    A key that comes again later names a new block, and the later one is kept.
    """
    w = Window.partitionBy(doc).orderBy(*order)
    principal = F.when(F.col(kind) == "COMPOSICAO", F.col(key))
    before = F.last(principal, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = (F.col(kind) == "COMPOSICAO") & ~F.col(key).eqNullSafe(before)
    numbered = islands(rows.withColumn("starts", starts), [doc], order, F.col("starts"), "block")
    # all by windows over the rows of a document, which are dealt once: joined to itself, all that made the rows would be done twice
    opened = F.last(F.when(F.col("starts"), F.struct(F.col(key).alias("key"))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    numbered = numbered.withColumn("block_key", F.when(F.col("block") > 0, opened["key"]))
    latest = F.max("block").over(Window.partitionBy(doc, "block_key"))
    return numbered.withColumn("latest", latest).where("block = 0 or (block_key is not null and block = latest)").drop("starts", "latest")


def adaptive_tolerance(height: Column) -> Column:
    """Of the heights of the words of a page: .45 of the median between 2 and 4.2, or 2.5."""
    return F.coalesce(F.greatest(F.lit(2.0), F.least(F.lit(4.2), F.median(height) * 0.45)), F.lit(2.5))


def _cluster(ys: list[float], tolerance: float, rule: str) -> list[int]:
    """Line numbers of words in order: against the running mean of the last line, or the first line that is near enough."""
    out: list[int] = []
    lines: list[list[float]] = []  # first value, mean, count
    for y in ys:
        at = -1
        if rule == "first_fit":
            at = next((i for i, line in enumerate(lines) if abs(line[0] - y) <= tolerance), -1)
        elif lines and abs(lines[-1][1] - y) <= tolerance:
            at = len(lines) - 1
        if at < 0:
            lines.append([y, y, 1])
            at = len(lines) - 1
        else:
            line = lines[at]
            line[1] = (line[1] * line[2] + y) / (line[2] + 1)
            line[2] += 1
        out.append(at)
    return out


def line_clusters(words: DataFrame, keys: list[str], anchor: str = "centre", tolerance: float | None = None, rule: str = "running_mean") -> DataFrame:
    """Words of a page into lines, with the text and box of each.

    ``words``: x0, y0, x1, y1, text.  anchor: centre or top; without a tolerance it
    follows the heights of the page.  The rule compares with what was accepted before,
    so a page is clustered in Python; a page is bounded.
    """
    kinds = dict(words.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "line_no int", "x0 double", "y0 double", "x1 double", "y1 double", "text string"])

    def lines(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(y=(pdf.y0 + pdf.y1) / 2 if anchor == "centre" else pdf.y0).sort_values(["y", "x0", "text"], kind="stable")
        height = (pdf.y1 - pdf.y0).median()
        tol = tolerance if tolerance is not None else (max(2.0, min(4.2, height * 0.45)) if height == height else 2.5)
        pdf = pdf.assign(line_no=_cluster(pdf.y.tolist(), tol, rule)).sort_values(["line_no", "x0", "text"], kind="stable")
        out = pdf.groupby("line_no", as_index=False).agg(x0=("x0", "min"), y0=("y0", "min"), x1=("x1", "max"), y1=("y1", "max"), text=("text", " ".join))
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "line_no", "x0", "y0", "x1", "y1", "text"]]

    return words.groupBy(*keys).applyInPandas(lines, schema)


def line_clusters_by_gap(words: DataFrame, keys: list[str], y: str, tolerance: float) -> DataFrame:
    """Lines by a fixed gap to the word before: all in windows, for where the exact rule is not needed."""
    w = Window.partitionBy(*keys).orderBy(y, "x0")
    starts = F.coalesce(F.col(y) - F.lag(y).over(w) > tolerance, F.lit(True))
    return islands(words.withColumn("starts", starts), keys, [y, "x0"], F.col("starts"), "line_no").drop("starts")


def barrier(text: Column) -> Column:
    """Why a line ends the row before it; empty if it does not."""
    return (
        F.when(text.rlike(r"^\s*\d+(\.\d+)+\s+\S+"), "budget_item_boundary")
        .when(text.rlike(r"(?i)^\s*(composi[cç][aã]o|insumo|auxiliar)\b"), "row_kind_boundary")
        .when(F.regexp_count(text, F.lit(r"\d{1,3}(?:\.\d{3})*,\d{2,7}")) >= 2, "financial_values_boundary")
        .when(text.rlike(r"(?i)^\s*(total|subtotal|valor)\b"), "total_boundary")
        .otherwise("")
    )


def line_profile(df: DataFrame, text: str = "text") -> DataFrame:
    """Words, barrier reason and whether a line floats (no barrier, no number)."""
    b = barrier(F.col(text))
    return df.withColumns({"n_words": F.size(F.split(F.trim(text), r"\s+")), "barrier": b, "floating": (b == "") & ~F.col(text).rlike(r"\d")})


def bounded_scan(lines: DataFrame, keys: list[str], anchors: DataFrame, max_lines: int = 4, max_gap: float = 18.0, up: bool = False) -> DataFrame:
    """The text that goes on below (or above) an anchor line: up to ``max_lines`` lines, each within ``max_gap`` of the last one taken.

    ``lines``: keys, y, text, barrier.  ``anchors``: keys, anchor_id, y.  Gaps are
    measured from the last accepted line, so a page is scanned in Python; lines and anchors of a page meet in a cogroup.
    """
    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["y", "text"], ascending=not up, kind="stable")
        rows = []
        for a in right.itertuples(index=False):
            taken, last = [], a.y
            for line in left.itertuples(index=False):
                gap = (last - line.y) if up else (line.y - last)
                if gap <= 0:
                    continue
                if gap > max_gap or line.barrier or len(taken) == max_lines or not any(c.isalpha() for c in line.text):
                    break
                taken.append(line.text)
                last = line.y
            rows.append([a.anchor_id, " ".join(reversed(taken) if up else taken), len(taken)])
        return pd.DataFrame(rows, columns=["anchor_id", "text", "n_lines"])

    return lines.groupBy(*keys).cogroup(anchors.groupBy(*keys)).applyInPandas(scan, "anchor_id long, text string, n_lines int")


def budget_fold(lines: DataFrame, doc: str = "doc_id", order: str = "ord", text: str = "text") -> DataFrame:
    """The lines of a budget as nodes of its tree, in one ordered pass over each document.

    A numbered line opens a node, a group if no quantity and price end it; what
    follows without a number is added to the open node; lines before the first are dropped.
    """
    head = re.compile(r"^(\d+(?:\.\d+)*)\s+(.+)$")
    tail = re.compile(r"^(.*?)\s+(\S+)\s+([\d.]+,\d+)\s+([\d.]+,\d+)\s+([\d.]+,\d+)$")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes: list[list] = []
        for r in pdf.sort_values(order, kind="stable").itertuples(index=False):
            s = " ".join((getattr(r, text) or "").split())
            m = head.match(s)
            if m:
                t = tail.match(m[2])
                nodes.append([m[1], "item", *t.groups()] if t else [m[1], "meta" if "." not in m[1] else "submeta", m[2], None, None, None, None])
            elif s and nodes:
                nodes[-1][2] = f"{nodes[-1][2]} {s}"
        out = pd.DataFrame(nodes, columns=["item", "tipo", "descricao", "und", "quant", "custo_unitario", "custo_parcial"])
        out.insert(0, doc, pdf[doc].iloc[0])
        return out

    kind = dict(lines.dtypes)[doc]
    return lines.groupBy(doc).applyInPandas(one, f"{doc} {kind}, item string, tipo string, descricao string, und string, quant string, custo_unitario string, custo_parcial string")
