"""Quality scores from Naive Bayes features in a linear support-vector model.

A text is turned into indicators of n-grams of word shapes (one, two or three
words; a word of over ``PIECE`` characters, as in text without spaces, counts as
several, so the whole text has its say).  Each indicator is scaled by the log of the ratio between the share of
good and of bad texts that have it; a hinge-loss model is fitted to the scaled
rows by dual coordinate descent, and its margins are turned into probabilities
by a logistic fit on margins of held-back folds.

Only the fit sees a bounded sample, ``MAX_TRAINING_ROWS`` labelled texts chosen
by a hash of their id.  Every whole text is scored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, id_and_text, with_column

MAX_TRAINING_ROWS = 8_000
BUCKETS = 1 << 18
#: An n-gram has one indicator for being there and one for each share of the text that it reaches.
SHARES = (0.02, 0.1, 0.3, 0.6)
MEMO = 200_000
#: Characters of a word that make one shape.
PIECE = 64


def _shape(word: str) -> str:
    """Letters by case, digits as 0, other characters as they are, runs as one."""
    out = []
    for ch in word:
        c = ("A" if ch.isupper() else "a") if ch.isalpha() else "0" if ch.isdigit() else ch
        if not out or out[-1] != c:
            out.append(c)
    return "".join(out)


def _words(text: str) -> list[str]:
    """The words of ``text``, long ones in pieces."""
    words = text.split()
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]


def features(text: str | None, memo: dict[str, str] | None = None) -> np.ndarray:
    """The sorted numbers of the indicators that hold for ``text``; an empty text has its own."""
    memo = {} if memo is None else memo
    words = _words(text or "")
    shapes = []
    last = None
    for w in words:
        if w == last:
            shapes.append("=")
            continue
        s = memo.get(w)
        if s is None:
            if len(memo) >= MEMO:
                memo.clear()
            s = memo[w] = _shape(w)
        shapes.append(s)
        last = w
    n = len(words)
    found = {f"n{int(math.log2(n + 1))}"}
    for size in (1, 2, 3):
        grams = Counter(shapes if size == 1 else zip(*(shapes[i:] for i in range(size))))
        total = max(1, n - size + 1)
        for gram, count in grams.items():
            name = f"{size}{gram}"
            found.add(name)
            for i, share in enumerate(SHARES):
                if count < share * total:
                    break
                found.add(f"{name}@{i}")
    lines = [x for x in (text or "").split("\n") if x.strip()]
    if lines:
        again = 1 - len(set(lines)) / len(lines)
        found.update(f"line@{i}" for i, share in enumerate((0.01, *SHARES)) if again >= share)
    return np.unique(np.fromiter((zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS for x in found), np.int64, len(found)))


@dataclass
class Model:
    """weights: of each bucket, log-count ratios included; a, b: of the logistic curve."""

    weights: dict[int, float] = field(default_factory=dict)
    bias: float = 0.0
    a: float = 1.0
    b: float = 0.0

    def score(self, active: np.ndarray) -> float:
        get = self.weights.get
        margin = self.bias + sum(get(x, 0.0) for x in active.tolist()) / math.sqrt(max(1, len(active)))
        z = self.a * margin + self.b
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def _ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    counts = [np.bincount(np.concatenate([r for r, g in zip(rows, good) if g == c]), minlength=BUCKETS) + 1.0 for c in (True, False)]
    share = [c / (k + 2.0) for c, k in zip(counts, (good.sum(), (~good).sum()))]
    seen = (counts[0] + counts[1]) > 2
    return np.where(seen, np.log(share[0] / share[1]), 0.0)


def _descend(rows: list[np.ndarray], good: np.ndarray, ratio: np.ndarray, c: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Hinge loss by dual coordinate descent over rows ratio[active] / sqrt(number active), with a constant as bias."""
    w, bias = np.zeros(BUCKETS), 0.0
    y = np.where(good, 1.0, -1.0)
    values = [ratio[r] / math.sqrt(max(1, len(r))) for r in rows]
    square = [float(v @ v) + 1.0 for v in values]
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i]
            grad = y[i] * (float(w[r] @ v) + bias) - 1.0
            new = min(c, max(0.0, alpha[i] - grad / square[i]))
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def _logistic(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """a and b of 1 / (1 + exp(-(a * margin + b))) by damped Newton steps on smoothed targets."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    ab = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones(len(margin))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (target - p))
        ab = ab + np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    return max(1e-3, float(ab[0])), float(ab[1])


def fit(rows: list[np.ndarray], labels: list[int], c: float = 1.0, epochs: int = 30, folds: int = 3, seed: int = 7) -> Model:
    """A model of label 1; with labels of one kind only, or none, a constant."""
    good = np.asarray(labels, dtype=np.int64) == 1
    if not len(good) or good.all() or not good.any():
        return Model(b=math.log((good.sum() + 1) / ((~good).sum() + 1)))
    margin = np.zeros(len(rows))
    fold = np.random.default_rng(seed).permutation(len(rows)) % folds
    for k in range(folds):
        train = np.flatnonzero(fold != k)
        if good[train].all() or not good[train].any():
            continue
        part, at = [rows[i] for i in train], good[train]
        ratio = _ratios(part, at)
        w, bias = _descend(part, at, ratio, c, epochs, seed)
        w = w * ratio
        for i in np.flatnonzero(fold == k):
            margin[i] = bias + w[rows[i]].sum() / math.sqrt(max(1, len(rows[i])))
    a, b = _logistic(margin, good)
    ratio = _ratios(rows, good)
    w, bias = _descend(rows, good, ratio, c, epochs, seed)
    w = w * ratio
    used = np.flatnonzero(w)
    return Model(dict(zip(used.tolist(), w[used].tolist())), float(bias), a, b)


def held_out(id_col: str = "doc_id"):
    """True for ids whose labels are never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """Fits on at most ``max_rows`` labelled texts, those with the smallest hashes of their ids."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, str] = {}
        for batch in batches:
            found = [features(t, memo).astype(np.int32).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("quality"), pa.array(found, pa.binary())], names=["doc_id", "quality", "active"])

    some = id_and_text(docs).join(F.broadcast(known), "doc_id")  # max_rows rows at most
    got = some.select("doc_id", "quality", "text").mapInArrow(rows, "doc_id long, quality int, active binary").collect()
    got = sorted((r.doc_id, r.quality, bytes(r.active)) for r in got)
    return fit([np.frombuffer(x, np.int32).astype(np.int64) for _, _, x in got], [q for _, q, _ in got])


def _scorer(shared, text_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, str] = {}
        model = shared.value
        for batch in batches:
            scores = [model.score(features(t, memo)) for t in batch.column(text_at).cast(pa.string()).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(scores, pa.float64())], names=names)

    return run


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 of each text.

    Null and empty texts have the score of a text without words.  A score depends
    on the text alone, so repeated rows agree.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights at most
    return docs.mapInArrow(_scorer(shared, docs.columns.index(text_col), [*docs.columns, score_col]), with_column(docs.schema, score_col, "double"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``."""
    out = with_scores(id_and_text(docs), train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``."""
    name = free_name(docs, "score")
    return with_scores(docs, train(docs, labels), score_col=name).where(F.col(name) >= threshold).drop(name)
