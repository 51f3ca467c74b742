"""Finding, by their anchors, the windows of a corpus that can occur twice.

A window is ``window`` tokens in a row (bytes or words).  Its anchor is the least
hash among its k-grams, so equal windows have equal anchors, wherever they are.
Windows in a row mostly share their anchor; such a run is shipped as one piece.

Documents are dealt to batches by a hash of their id and shuffled once; the
stages that follow read those same shuffle files.  First the anchors only are
compared, four bytes each: a run whose anchor no other run has is done.  All
else that must meet is dealt to shards by anchor.  A batch names equal pieces
once, however many of its documents have them, so a shard gets at most one copy
of a piece from each batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, id_and_text, partitions

#: Id of documents without one: they come last.
NO_ID = 2**63 - 1
#: Bytes of text handled at once, so that the arrays stay in the cache.
CHUNK = 1 << 18
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_ODD2 = _U(0xC2B2AE3D27D4EB4F)
_ODD3 = _U(0x165667B19E3779F9)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    h = h ^ (h >> _U(31))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(29))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(32))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BYTE2 = mixed(np.arange(257, 513, dtype=np.uint64) * _ODD2)


def rolling(t: np.ndarray, k: int, odd: np.uint64 = _ODD) -> np.ndarray:
    """Polynomial hashes of all k-grams, put together from those of 1, 2, 4, ... tokens."""
    power = lambda n: _U(pow(int(odd), n, 1 << 64))
    out, done, now, width = None, 0, t, 1
    while True:
        if k & width:
            if out is None:
                out, done = now, width
            else:
                n = len(t) - done - width + 1
                out = out[:n] * power(width) + now[done : done + n]
                done += width
        if width * 2 > k:
            return out
        n = len(t) - 2 * width + 1
        now = now[:n] * power(width) + now[width : width + n]
        width *= 2


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    span = 1
    n = len(h) - width + 1
    while span * 2 <= width:
        h = np.minimum(h[: len(h) - span], h[span:])
        span *= 2
    return np.minimum(h[:n], h[width - span : width - span + n])


@dataclass
class Runs:
    """Runs of windows in the tokens of a chunk: first token, number of windows, anchor, document and its tokens."""

    start: np.ndarray
    n: np.ndarray
    anchor: np.ndarray
    doc: np.ndarray
    #: Hash of the run's whole content, and another.
    content: np.ndarray
    content2: np.ndarray


def runs(t: np.ndarray, bounds: np.ndarray, k: int, window: int, both: bool = False) -> Runs:
    """bounds: where each document starts, and the end.  No window crosses one.  content2 is made only with ``both``."""
    none = np.empty(0, np.int64)
    length = np.diff(bounds)
    has = np.flatnonzero(length >= window)
    if not len(has):
        return Runs(none, none, none.view(np.uint64), none, none.view(np.uint64), none.view(np.uint64))
    step = np.zeros(len(t) + 1, np.int8)
    step[bounds[has]] += 1
    step[bounds[has] + length[has] - window + 1] -= 1
    at = np.flatnonzero(np.cumsum(step[: len(t) - window + 1]))
    most = window - k + 1
    least = sliding_min(mixed(rolling(t, k)), most)[at]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    parts = -(-n // most)  # a k-gram that comes again and again makes long runs
    inside = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(at[first], parts) + inside * most
    n = np.minimum(most, np.repeat(n, parts) - inside * most)
    hashes = []
    for odd in (_ODD2, _ODD3) if both else (_ODD2,):
        whole = rolling(t if odd == _ODD2 else mixed(t), window, odd)
        hashes.append(mixed(mixed(whole[start] + n.astype(np.uint64)) ^ (whole[start + n - 1] * _ODD)))
    return Runs(start, n, mixed(np.repeat(least[first], parts)), np.searchsorted(bounds, start, "right") - 1, hashes[0], hashes[-1])


def repeats_itself(t: np.ndarray, r: Runs, k: int, window: int) -> np.ndarray:
    """Which runs have two equal windows: those can only be fewer than window - k + 1 apart."""
    whole = rolling(t, window) if len(t) >= window else np.empty(0, np.uint64)
    same = np.zeros(len(whole) + 1, np.int64)
    for apart in range(1, min(window - k + 1, len(whole))):
        same[:-1][apart:] |= whole[apart:] == whole[:-apart]
    same = np.concatenate(([0], np.cumsum(same)))
    return same[r.start + r.n] > same[r.start]


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about CHUNK bytes."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def byte_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, bounds, and the bytes themselves."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    return _BYTE[raw], np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64), raw


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_INVERSE = _U(pow(int(_ODD), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _upto(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, x in enumerate((_ODD, _INVERSE)):
            factors = np.full(n, x, np.uint64)
            factors[0] = 1
            _powers[i] = np.multiply.accumulate(factors)
    return _powers


def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in text."""
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = _SPACE[raw]
    turn = np.flatnonzero(space[1:] != space[:-1])
    return turn[::2], turn[1::2]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """A hash of each word, from sums over all the text before its start and end."""
    up, down = _upto(max(len(raw), CHUNK * 2))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(table[raw] * up[: len(raw)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD2)


def word_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Tokens, bounds, and the text with the places of the words in it."""
    raw = np.frombuffer(b" ".join(texts), np.uint8)
    starts, ends = words_of(raw)
    offset = np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts])))
    return word_hashes(raw, starts, ends), np.searchsorted(starts, offset).astype(np.int64), (raw, starts, ends)


def span_prints(tokens: np.ndarray, words: tuple, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the words start..stop of each span: of ``word_hashes`` and of others by another table."""
    raw, begins, ends = words
    out = []
    for hashes, odd in ((tokens, _ODD), (word_hashes(raw, begins, ends, _BYTE2), _ODD2)):
        up, down = _upto(max(len(hashes) + 1, CHUNK * 2))
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mixed(hashes ^ odd) * up[: len(hashes)], out=sums[1:])
        out.append(mixed((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64) * odd))
    return out[0], out[1]


def even_keys(spark: SparkSession, p: int, n: int) -> list[int]:
    """n numbers of which the i-th is dealt to partition i modulo p by hash, so that all get equally many."""
    want = -(-n // p)
    found: dict[int, list[int]] = {i: [] for i in range(p)}
    at = 0
    while any(len(x) < want for x in found.values()):
        step = max(4096, 16 * n)
        for k, where in spark.range(at, at + step).select(F.col("id").cast("int").alias("k"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(p)).alias("w")).collect():
            if len(found[where]) < want:
                found[where].append(k)
        at += step
    return [found[i % p][i // p] for i in range(n)]


@dataclass
class Plan:
    """How the work of one run is dealt out.  shards: a power of two, bits its logarithm."""

    window: int
    k: int
    batches: list[int]
    shards: list[int]
    bits: int
    p: int

    def place(self, anchor: np.ndarray) -> np.ndarray:
        """Shard and 32 further bits of an anchor, as one number."""
        return anchor >> _U(32 - self.bits)


def dealt(docs: DataFrame, window: int, k: int, id_col: str, text_col: str) -> tuple[DataFrame, Plan]:
    """The documents by batch, and the plan."""
    spark = docs.sparkSession
    p = partitions(spark)
    bits = min(16, max(1, (2 * p - 1).bit_length()))
    plan = Plan(window, k, even_keys(spark, p, p), even_keys(spark, p, 1 << bits), bits, p)
    rows = id_and_text(docs, id_col, text_col)
    keys = F.array(*[F.lit(x) for x in plan.batches])
    batch = F.element_at(keys, (F.pmod(F.xxhash64("doc_id"), F.lit(p)) + 1).cast("int"))
    return rows.select(batch.alias("batch"), "doc_id", "text").repartition(p, "batch"), plan


def read(t: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """Ids, NO_ID for null, and texts, by id."""
    ids = t.column("doc_id").combine_chunks().fill_null(NO_ID).to_numpy()
    order = np.argsort(ids, kind="stable")
    texts = as_bytes(t.column("text").combine_chunks())
    return ids[order], [texts[i] for i in order.tolist()]


def shared_anchors(docs: DataFrame, plan: Plan, tokens, other_document: bool) -> DataFrame:
    """batch, and the places of the anchors (as bytes of numbers) that also occur elsewhere.

    Elsewhere means in another document, or else in any other run.
    """
    shard_keys, bits = np.array(plan.shards, np.int32), plan.bits

    def anchors(t: pa.Table) -> pa.Table:
        ids, texts = read(t)
        places, whose, again = [], [], []
        at = 0
        for a, b in chunks(texts):
            toks, bounds, _ = tokens(texts[a:b])
            r = runs(toks, bounds, plan.k, plan.window)
            places.append(plan.place(r.anchor))
            whose.append(ids[a + r.doc] if other_document else at + np.arange(len(r.doc)))
            again.append(np.zeros(len(r.doc), bool) if other_document else repeats_itself(toks, r, plan.k, plan.window))
            at += len(r.doc)
        place, own, again = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (places, whose, again))
        place = place.astype(np.uint64)
        order = np.argsort(place, kind="stable")
        place, own = place[order], own[order]
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.empty(0, np.int64)
        last = np.append(first, len(place))[1:] - 1
        several = own[first] != own[last]
        if len(first):
            several |= np.logical_or.reduceat(again[order], first)
        place = place[first]
        edge = np.searchsorted(place, np.arange(len(shard_keys) + 1, dtype=np.uint64) << _U(32))
        some = np.flatnonzero(np.diff(edge))
        low = place.astype(np.uint32)
        return pa.table(
            {
                "shard": pa.array(shard_keys[some], pa.int32()),
                "batch": pa.array([t.column("batch")[0].as_py()] * len(some), pa.int32()),
                "high": pa.array(some, pa.int32()),
                "low": pa.array([low[edge[i] : edge[i + 1]].tobytes() for i in some], pa.binary()),
                "several": pa.array([np.packbits(several[edge[i] : edge[i + 1]]).tobytes() for i in some], pa.binary()),
            }
        )

    def shared(t: pa.Table) -> pa.Table:
        lows = [np.frombuffer(x, np.uint32) for x in t.column("low").to_pylist()]
        several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(y)) for x, y in zip(t.column("several").to_pylist(), lows)]
        every = np.concatenate(lows)
        order = np.argsort(every, kind="stable")
        value = every[order]
        first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
        count = np.diff(np.append(first, len(value)))
        keep = (count > 1) | (np.add.reduceat(np.concatenate(several)[order].astype(np.int64), first) > 0)
        mark = np.empty(len(value), bool)
        mark[order] = np.repeat(keep, count)
        edge = np.concatenate(([0], np.cumsum([len(x) for x in lows])))
        high = np.uint64(t.column("high")[0].as_py()) << _U(32)
        out = [(high | x[mark[a:b]].astype(np.uint64)).tobytes() for x, a, b in zip(lows, edge[:-1], edge[1:])]
        return pa.table({"batch": t.column("batch"), "places": pa.array(out, pa.binary())})

    found = docs.groupBy("batch").applyInArrow(anchors, "shard int, batch int, high int, low binary, several binary")
    return found.repartition(plan.p, "shard").groupBy("shard").applyInArrow(shared, "batch int, places binary")


def places_of(t: pa.Table) -> np.ndarray:
    """The places that ``shared_anchors`` names to a batch, sorted."""
    parts = [np.frombuffer(x, np.uint64) for x in t.column("places").to_pylist()]
    return np.sort(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def among(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are in the sorted ``known``, and where."""
    if not len(known):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values, at


def among_two(values: np.ndarray, values2: np.ndarray, known: np.ndarray, known2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of values are among the known pairs, sorted by both, and where."""
    hit, at = among(values, known)
    while (other := hit & (known2[at] != values2)).any() if len(known) else False:
        at = np.where(other, np.minimum(at + 1, len(known) - 1), at)
        hit = hit & ~(other & ((known[at] != values) | ((known2[at] != values2) & (at == len(known) - 1))))
    return hit, at


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] of them, and so on."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
