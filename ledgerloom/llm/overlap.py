"""Pairs of sets with a Jaccard similarity, by a prefix filter that loses none.

The members of all sets are put in one order, frequent ones last.  Two sets of a
given similarity share a number of members among the first few of both, so pairs
come from blocks, one for each member that stands so early in two sets, and count
if they meet in enough of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, partitions, whole_groups
from .shingles import shingle_hashes, words_id

#: Pairs looked at, at once.
AT_ONCE = 2_000_000
#: Members that a task counts at once, the most frequent of them that it names, and of all tasks.
KNOWN = 2_000_000
NAMED = 50_000
FREQUENT = 500_000
#: 64-bit words by which the tokens of a text are told at a glance.
WORDS = 4
#: Texts next to one another in a block that are tried before all.
BESIDE = 3
#: Texts a task remembers to have seen.
SEEN = 1_000_000


class Counts:
    """In how many sets each member is; those met once are forgotten when there are too many."""

    def __init__(self):
        self.value, self.n = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.new: list[np.ndarray] = []
        self.size = 0

    def add(self, sets: list[np.ndarray]) -> None:
        self.new += sets
        self.size += sum(map(len, sets))
        if self.size > KNOWN:
            self._count()

    def _count(self) -> None:
        value, n = np.unique(np.concatenate([np.empty(0, np.uint64), *self.new]), return_counts=True)
        value, at = np.unique(np.concatenate((self.value, value)), return_inverse=True)
        n = np.bincount(at, np.concatenate((self.n, n)), len(value)).astype(np.int64)
        if len(value) > KNOWN // 4:
            kept = n > 1
            value, n = value[kept], n[kept]
            if len(value) > KNOWN // 2:
                kept = np.sort(np.argsort(-n, kind="stable")[: KNOWN // 2])
                value, n = value[kept], n[kept]
        self.value, self.n, self.new, self.size = value, n, [], 0

    def most(self) -> tuple[np.ndarray, np.ndarray]:
        """The most frequent members, and their numbers of sets."""
        self._count()
        at = np.flatnonzero(self.n > 1)
        at = at[np.argsort(-self.n[at], kind="stable")[:NAMED]]
        return self.value[at], self.n[at]


def prefix(hashes: np.ndarray, similarity: float, known: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of a set the rarest members, so many that a set as similar as ``similarity`` has one of its own rarest among them.

    The order, the same for all sets, is by ``rank`` of the hashes in ``known`` (sorted), which come after all others, then by hash.
    """
    n = len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1
    place = np.zeros(len(hashes), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        place = np.where(known[at] == hashes, rank[at], 0)
    return hashes[np.lexsort((hashes, place))[:n]]


def blocks_of_two(texts: DataFrame, top: np.ndarray, shingle: int, similarity: float) -> DataFrame:
    """token, same, size: the prefix members of each text that another text of fitting size also has in its prefix.

    same names a text by its words; size is the number of its shingles.
    ``top`` are frequent shingles, the most frequent first (``FREQUENT`` at most).
    """
    p = partitions(texts.sparkSession)
    order = np.argsort(top)
    given = texts.sparkSession.sparkContext.broadcast((top[order], len(top) - order))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = given.value
        seen: set[int] = set()
        for batch in batches:
            found: list[tuple[int, int, np.ndarray]] = []
            for t in as_bytes(batch.column("text")):
                same = words_id(t)
                if same not in seen and len(h := np.unique(shingle_hashes(t, shingle))):
                    found.append((same, len(h), prefix(h, similarity, known, rank)))
                    seen.add(same)
            if len(seen) > SEEN:
                seen.clear()
            if found:
                n = [len(h) for _, _, h in found]
                columns = (
                    np.concatenate([h for _, _, h in found]).view(np.int64), np.repeat(np.array([s for s, _, _ in found], np.uint64).view(np.int64), n),
                    np.repeat(np.array([s for _, s, _ in found], np.int32), n),
                )
                yield pa.record_batch([pa.array(x) for x in columns], names=["token", "same", "size"])

    def partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows stand by token and size, so a text has a partner if the next text or the one before fits."""
        last = None  # the last row of the batch before, and whether it is out already
        out = False
        for batch in batches:
            x = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)
            if last is not None:
                x = np.concatenate((last[None], x))
            if not len(x):
                continue
            new = np.concatenate(([True], (x[1:, :2] != x[:-1, :2]).any(axis=1)))  # repeated texts
            first_out = out
            x = x[new]
            fits = (x[1:, 0] == x[:-1, 0]) & (x[:-1, 2] >= similarity * x[1:, 2] - 1e-9)
            kept = np.zeros(len(x), bool)
            kept[1:] |= fits
            kept[:-1] |= fits
            out = bool(kept[-1]) or (first_out and len(x) == 1)
            if first_out:
                kept[0] = False
            last = x[-1]
            y = x[kept]
            if len(y):
                yield pa.record_batch([pa.array(y[:, 0]), pa.array(y[:, 1]), pa.array(y[:, 2].astype(np.int32))], names=["token", "same", "size"])

    kinds = "token long, same long, size int"
    rows = texts.select("text").mapInArrow(prefixes, kinds).repartition(p, "token").sortWithinPartitions("token", "size", "same")
    return rows.mapInArrow(partnered, kinds)


def least_shared(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """How many members of their prefixes two sets of n and m members share at least, if they are similar.

    Of the two prefixes one ends first in the common order.  What the sets share
    up to there is in both; after it that set has no more than the members outside its prefix.
    """
    both = np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)
    rest = np.ceil(similarity * np.maximum(n, m) - 1e-9) - 1
    return np.maximum(1, both - rest).astype(np.int64)


def block_pairs(token: np.ndarray, same: np.ndarray, label: np.ndarray, size: np.ndarray, similarity: float, met: np.ndarray | None = None, bits: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of unlike label and fitting size that share a token: both names, how many tokens, and how many they must share at least; some at a time.

    ``bits`` has a bit for each token that stands for a text in any block (tokens may share
    bits), ``met`` their number; pairs of too few common bits are left out at once.

    Of two texts of unlike label one at least is not of the label that most in the
    block have, so only those look for partners: a block of one large group costs
    no more than its few others times its rows.
    """
    order = np.lexsort((same, size, token))
    token, same, label, size = (x[order] for x in (token, same, label, size))
    if bits is not None:
        bits = bits[order]
        more = met[order] - np.bitwise_count(bits).sum(1, dtype=np.int64)  # tokens on a bit that another has set
    group = np.cumsum(np.concatenate(([False], token[1:] != token[:-1])))
    by_label = np.lexsort((label, group))
    g, l = group[by_label], label[by_label]
    first = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (l[1:] != l[:-1]))))
    times = np.diff(np.append(first, len(g)))
    most = np.lexsort((-times, g[first]))
    most = most[np.concatenate(([True], g[first[most]][1:] != g[first[most]][:-1]))]
    seeking = label != l[first[most]][group]
    seeks = np.flatnonzero(seeking)
    wide = int(size.max()) + 2
    place = group * wide + size
    lo = np.searchsorted(place, group[seeks] * wide + np.ceil(size[seeks] * similarity - 1e-9).astype(np.int64))
    hi = np.searchsorted(place, group[seeks] * wide + np.minimum(np.floor(size[seeks] / similarity + 1e-9).astype(np.int64), wide - 1), "right")
    upto = np.cumsum(hi - lo)
    start = 0
    while start < len(seeks):
        done = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, done + AT_ONCE, "right")))
        n = (hi - lo)[start:stop]
        i = np.repeat(seeks[start:stop], n)
        j = np.repeat(lo[start:stop] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        start = stop
        good = (label[i] != label[j]) & (~seeking[j] | (i < j))  # two that both look meet once
        i, j = i[good], j[good]
        if bits is not None:
            most_shared = np.bitwise_count(bits[i] & bits[j]).sum(1, dtype=np.int64) + np.minimum(more[i], more[j])
            good = most_shared >= least_shared(size[i], size[j], similarity)
            i, j = i[good], j[good]
        swap = same[i] > same[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        rows, at, shared = np.unique(np.stack((same[i], same[j]), axis=1), axis=0, return_index=True, return_counts=True)
        yield rows[:, 0], rows[:, 1], shared, least_shared(size[i[at]], size[j[at]], similarity)


def shuffled(names: np.ndarray, turn: int) -> np.ndarray:
    """Numbers that put names in another order each turn."""
    x = names.astype(np.int64).view(np.uint64) + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def chain_pairs(token: np.ndarray, same: np.ndarray, label: np.ndarray, size: np.ndarray, similarity: float, turn: int = 0) -> tuple[np.ndarray, ...]:
    """Of each block, whose texts stand in an order of this turn, the pairs of a text with ``BESIDE`` after it
    and with the nearest of unlike label on either side, as in ``block_pairs``; no more than a few for each row."""
    order = np.lexsort((same, shuffled(same, turn), token))
    token, same, label, size = (x[order] for x in (token, same, label, size))
    start = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (label[1:] != label[:-1]))))  # of runs of one label
    run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(token))))
    row = np.arange(len(token))
    i = [row[: max(0, len(row) - d)] for d in range(1, BESIDE + 1)] + [row[run < len(start) - 1], row[run > 0]]
    j = [row[d:] for d in range(1, BESIDE + 1)] + [start[run[i[-2]] + 1], start[run[i[-1]]] - 1]
    i, j = np.concatenate(i), np.concatenate(j)
    good = (token[i] == token[j]) & (label[i] != label[j]) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9)
    pair = np.unique(np.sort(np.stack((i[good], j[good]), axis=1), axis=1), axis=0)  # once in a block
    i, j = pair[:, 0], pair[:, 1]
    swap = same[i] > same[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    rows, at, shared = np.unique(np.stack((same[i], same[j]), axis=1), axis=0, return_index=True, return_counts=True)
    return rows[:, 0], rows[:, 1], shared, -(-least_shared(size[i[at]], size[j[at]], similarity) // 2)


def pairs_in_blocks(blocks: DataFrame, label: DataFrame | None, similarity: float, turn: int | None = None) -> DataFrame:
    """a, b: pairs of unlike label that may be as similar as ``similarity``; a text not in ``label`` (same, label) is its own.

    All pairs that meet in enough blocks, or with ``turn`` only a few for each text of a block, others each turn.
    """
    p = partitions(blocks.sparkSession)
    if label is None:
        rows = blocks.select("token", "same", F.col("same").alias("label"), "size")
    else:
        rows = blocks.join(label, "same", "left").select("token", "same", F.coalesce("label", "same").alias("label"), "size")
    if turn is None:
        at = F.pmod(F.xxhash64("token"), F.lit(64 * WORDS))
        words = [F.bit_or(F.when(F.floor(at / 64) == w, F.expr(f"shiftleft(1L, cast(pmod(xxhash64(token), {64 * WORDS}) % 64 as int))")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(WORDS)]
        rows = rows.join(blocks.groupBy("same").agg(F.count(F.lit(1)).alias("met"), *words), "same").select("token", "same", "label", "size", "met", *[f"w{w}" for w in range(WORDS)])
    rows = rows.repartition(p, "token").sortWithinPartitions("token")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in whole_groups(batches, 1):
            token, same, label, size = (np.ascontiguousarray(c) for c in x[:, :4].T)
            found = [chain_pairs(token, same, label, size, similarity, turn)] if turn is not None else block_pairs(token, same, label, size, similarity, x[:, 4], np.ascontiguousarray(x[:, 5:]).view(np.uint64))
            for columns in found:
                yield pa.record_batch([pa.array(c) for c in columns], names=["a", "b", "shared", "least"])

    met = rows.mapInArrow(pairs, "a long, b long, shared long, least long").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("least").alias("least"))
    return cut(met.where("shared >= least").select("a", "b"))


def alike_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets (same, shingles: sorted 64-bit hashes) are as similar as ``similarity``."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for u, v in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                u, v = np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                good.append(both >= similarity * (len(u) + len(v) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    ab = pairs.join(sets.withColumnsRenamed({"same": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"same": "b", "shingles": "y"}), "b")
    return ab.select("a", "b", "x", "y").mapInArrow(alike, "a long, b long")
