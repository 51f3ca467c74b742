"""Benchmark passages in documents, paraphrases included, by latent semantic search.

Words of the benchmark span the space; other words do not change a dot product with
an item.  Three passes go over the documents.  The first counts in how many
passages each word is, for TF-IDF.  The second multiplies the TF-IDF matrix of all
passages, and its transpose, with random columns, a partial sum for each task;
from the sums comes a randomised singular value decomposition.  The third maps
every passage to the latent space, takes all items with a cosine of ``min_cosine``
or more, and holds each against the words: their longest common subsequence must
cover ``min_common`` of the item and ``min_answer`` of its answer, its last quarter.

What the cosine passes over, such as a short item among many words of the benchmark,
is sought by words: a run that covers ``min_common`` of an item lacks no more than the
rest of its words, so of the rarer half of them it has a known number.  Windows of
blocks that have as many are held against the words as well; no run of up to
``SPARE`` words more than the item is lost.

The benchmark is the query set and is held by every task, as are its words times
``rank`` numbers; neither grows with the documents.  Items weigh in on the
decomposition like the documents do, so that with fewer items than ``rank`` the
space keeps each of them apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import chunks, word_hashes, words_of
from .common import id_and_text

#: Words of a block; a passage is two blocks in a row.
BLOCK = 32
#: Words that may come between those of an item.
SPARE = 8
#: Features summed together.
SLICE = 64
_PUNCTUATION = bytes(i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))


def normal(text: str | None) -> bytes:
    """Lower case, ASCII signs as spaces."""
    return (text or "").lower().encode("utf-8", "replace").translate(_PUNCTUATION)


class Vocabulary:
    """Feature numbers of word hashes, by tables on a few bits of them; words that share an entry go on to a further table."""

    BITS = 18

    def __init__(self, words: np.ndarray):
        self.words = words
        self.tables: list[np.ndarray] = []
        rest = np.arange(len(words), dtype=np.int32)
        while len(rest):
            table = np.full(1 << self.BITS, -1, np.int32)
            at = self._entry(words[rest], len(self.tables))
            table[at] = rest
            self.tables.append(table)
            rest = rest[table[at] != rest]

    def __len__(self) -> int:
        return len(self.words)

    def _entry(self, words: np.ndarray, n: int) -> np.ndarray:
        return ((words >> np.uint64(11 * (n % 5))) & np.uint64((1 << self.BITS) - 1)).astype(np.int64)

    def find(self, words: np.ndarray) -> np.ndarray:
        """The feature of each word, or -1."""
        out = np.full(len(words), -1, np.int32)
        left = None
        for n, table in enumerate(self.tables):
            some = words if left is None else words[left]
            found = table[self._entry(some, n)]
            good = found >= 0
            good[good] = self.words[found[good]] == some[good]
            where = np.flatnonzero(good) if left is None else left[good]
            out[where] = found[good]
            again = (found >= 0) & ~good
            left = np.flatnonzero(again) if left is None else left[again]
            if not len(left):
                break
        return out


NOTHING = Vocabulary(np.empty(0, np.uint64))


@dataclass
class Tokens:
    """Of a few texts: hash of each word; where texts start; feature numbers of the words that have one, and their blocks."""

    hashes: np.ndarray
    bounds: np.ndarray
    feature: np.ndarray
    block: np.ndarray
    #: The first block of each text, and their number.
    blocks: np.ndarray


def read(texts: list[bytes], vocabulary: Vocabulary) -> Tokens:
    raw = np.frombuffer(b" ".join(texts), np.uint8)
    starts, ends = words_of(raw)
    hashes = word_hashes(raw, starts, ends)
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts]))))
    n = np.diff(bounds)
    blocks = np.concatenate(([0], np.cumsum(-(-n // BLOCK))))
    at = vocabulary.find(hashes)
    has = np.flatnonzero(at >= 0)
    doc = np.searchsorted(bounds, has, "right") - 1
    return Tokens(hashes, bounds, at[has], blocks[doc] + (has - bounds[doc]) // BLOCK, blocks)


#: Rows added to one place by rounds; what a place gets beyond them is summed first.
ROUNDS = 16


def add_rows(out: np.ndarray, at: np.ndarray, rows: np.ndarray, which: np.ndarray) -> None:
    """Adds ``rows[which]`` to ``out[at]``; ``at`` ascends and may repeat.

    The k-th rows of all places are added together, as no place is among them twice.
    """
    if not len(at):
        return
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    n = np.diff(first, append=len(at))
    for k in range(min(ROUNDS, int(n.max()))):
        some = first[n > k] + k
        out[at[some]] += rows[which[some]]
    rest = np.flatnonzero(np.arange(len(at)) - np.repeat(first, n) >= ROUNDS)
    if len(rest):
        heads = np.flatnonzero(np.concatenate(([True], np.diff(at[rest]) != 0)))
        out[at[rest[heads]]] += np.add.reduceat(rows[which[rest]], heads, axis=0)


class Rows:
    """A row of numbers for each feature, to be summed over blocks.

    The most frequent features make up most words: those are counted in a table of
    blocks by features and summed in one matrix product; the others one by one.
    """

    FREQUENT = 320

    def __init__(self, rows: np.ndarray, frequency: np.ndarray):
        self.rows = np.ascontiguousarray(rows, np.float32)
        self.top = np.argsort(-frequency, kind="stable")[: self.FREQUENT]
        self.place = np.full(len(rows), -1, np.int64)
        self.place[self.top] = np.arange(len(self.top))
        self.top_rows = self.rows[self.top]

    def counts(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of frequent features by block; feature and block of the other words."""
        place = self.place[t.feature]
        often = place >= 0
        size = (int(t.blocks[-1]), len(self.top))
        table = np.bincount(t.block[often] * size[1] + place[often], minlength=size[0] * size[1]).astype(np.float32).reshape(size)
        return table, t.feature[~often], t.block[~often]

    def sums(self, t: Tokens) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The sum over the words of each block, and the counts."""
        counts = table, feature, block = self.counts(t)
        out = table @ self.top_rows
        add_rows(out, block, self.rows, feature)
        return out, counts


@dataclass
class Items:
    ids: list[int | None]
    words: list[np.ndarray]
    vocabulary: Vocabulary


def items_of(benchmark: DataFrame, id_col: str, text_col: str) -> Items:
    """The benchmark on the driver; items without words are left out."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).collect()
    ids, words = [], []
    for r in sorted(rows, key=lambda r: (r.i is None, r.i or 0, r.t or "")):
        found = read([normal(r.t)], NOTHING).hashes
        if len(found):
            ids.append(r.i)
            words.append(found)
    return Items(ids, words, Vocabulary(np.unique(np.concatenate(words))) if words else NOTHING)


def _texts(batches: Iterator[pa.RecordBatch], at: int = 0) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        yield batch, [normal(x) for x in batch.column(at).to_pylist()]


def _document_frequencies(texts: DataFrame, shared) -> tuple[np.ndarray, int]:
    """In how many blocks each feature is, and the number of blocks; summed by feature, partial sums first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value.vocabulary
        d = len(vocabulary)
        count, n = np.zeros(d, np.int64), 0
        for _, some in _texts(batches):
            for a, b in chunks(some):
                t = read(some[a:b], vocabulary)
                count += np.bincount(np.unique(t.block * d + t.feature) % d, minlength=d)
                n += int(t.blocks[-1])
        has = np.flatnonzero(count)
        yield pa.record_batch([pa.array(np.append(has, -1)), pa.array(np.append(count[has], n))], names=["feature", "n"])

    out, blocks = np.zeros(len(shared.value.vocabulary), np.int64), 0
    for r in texts.mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        if r.feature < 0:
            blocks = r.n
        else:
            out[r.feature] = r.n
    return out, blocks


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def latent_basis(texts: DataFrame, items: Items, shared, rank: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequency and IDF of each feature, and the right singular vectors of the TF-IDF rows of all blocks and items.

    One pass gives Z = A'A R for random R.  With Q a basis of Z, Q'A'AQ follows
    from Z and Q'R, and its eigenvectors turn Q into singular vectors.
    """
    d = len(items.vocabulary)
    frequency, blocks = _document_frequencies(texts, shared)
    idf = np.log((1.0 + blocks) / (1.0 + frequency)) + 0.1
    width = min(d, rank + 16)
    random = np.random.default_rng(seed).standard_normal((d, width)).astype(np.float32)
    context = texts.sparkSession.sparkContext
    given = context.broadcast((idf.astype(np.float32), Rows(idf[:, None] * random, frequency)))

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, (idf, weighted) = shared.value.vocabulary, given.value
        z = np.zeros(weighted.rows.shape, np.float32)
        often = np.zeros(weighted.top_rows.shape, np.float32)
        for _, some in _texts(batches):
            for a, b in chunks(some):
                t = read(some[a:b], vocabulary)
                if not len(t.feature):
                    continue
                y, (table, feature, block) = weighted.sums(t)
                square = np.bincount(t.block, idf[t.feature] ** 2, len(y)).astype(np.float32)
                y *= np.divide(1, square, out=np.zeros_like(square), where=square > 0)[:, None]
                often += table.T @ y
                order = np.argsort(feature, kind="stable")
                add_rows(z, feature[order], y, block[order])
        z[weighted.top] += often
        z *= idf[:, None]
        places = [i for i in range(0, len(z), SLICE) if z[i : i + SLICE].any()]
        yield pa.record_batch([pa.array(places, pa.int32()), pa.array([z[i : i + SLICE].tobytes() for i in places], pa.binary())], names=["place", "part"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in t.column("part").to_pylist())
        return pa.table({"place": t.column("place")[:1], "part": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    parts = texts.mapInArrow(product, "place int, part binary").withColumn("some", F.spark_partition_id() % 16)
    # a place gets one part of each task: first those of some tasks are added, then the sums
    parts = parts.groupBy("place", "some").applyInArrow(lambda t: add(t), "place int, part binary").groupBy("place").applyInArrow(lambda t: add(t), "place int, part binary")
    z = np.zeros((d, width))
    for r in parts.collect():  # words of the benchmark times rank numbers
        z[r.place : r.place + SLICE] = np.frombuffer(bytes(r.part), np.float32).reshape(-1, width)
    own = _unit(np.stack([np.bincount(items.vocabulary.find(w), minlength=d) * idf for w in items.words]))
    z += max(1.0, blocks / len(own)) * (own.T @ (own @ random))
    q, _ = np.linalg.qr(z)
    small = (q.T @ z) @ np.linalg.pinv(q.T @ random)
    value, vector = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-value)[: min(rank, width)]
    return frequency, idf, q @ vector[:, best]


def word_bits(a: list[int]) -> dict[int, int]:
    """A bit for each place of a word in ``a``."""
    places: dict[int, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    return places


def _common(hits: list[int], size: int) -> int:
    full = (1 << size) - 1
    state = full
    for bits in hits:
        hit = state & bits
        state = ((state + hit) | (state - hit)) & full
    return size - state.bit_count()


def common_words(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence; a bit for each word of ``a``."""
    return _common(list(filter(None, map(word_bits(a).get, b))), len(a))


class Search:
    """What every task of the last pass holds."""

    def __init__(self, items: Items, frequency: np.ndarray, idf: np.ndarray, basis: np.ndarray, min_cosine: float, min_common: float, min_answer: float):
        self.items, self.min_cosine, self.min_common, self.min_answer = items, min_cosine, min_common, min_answer
        self.rows = Rows(idf[:, None] * basis, frequency)
        queries, self.of = [], []
        for i, w in enumerate(items.words):  # a long item is sought by each of its passages
            for at in range(0, max(1, len(w) - BLOCK), 2 * BLOCK if len(w) <= 3 * BLOCK else BLOCK):
                part = w[at : at + 2 * BLOCK] if len(w) > 3 * BLOCK else w
                queries.append(self.rows.rows[items.vocabulary.find(part)].sum(0))
                self.of.append(i)
                if len(w) <= 3 * BLOCK:
                    break
        self.queries = _unit(np.array(queries, np.float32)).T.copy()
        self.of = np.array(self.of)
        self.lists = [w.tolist() for w in items.words]
        self.bits = [word_bits(w) for w in self.lists]
        # of each item its rarer words, and how many of them a run that holds it cannot lack; items by the blocks that a run may touch
        wide = np.array([(len(w) + SPARE - 2) // BLOCK + 2 for w in items.words])
        self.by_width = np.argsort(wide, kind="stable")
        self.wide, self.width_at = np.unique(wide[self.by_width], return_index=True)
        self.least = np.zeros(len(wide), np.int32)
        pairs = []
        for place, i in enumerate(self.by_width.tolist()):
            feature = items.vocabulary.find(items.words[i])
            lacks = len(feature) - int(np.ceil(min_common * len(feature) - 1e-9))
            n = min(len(feature), max(-(-len(feature) // 2), lacks + 1))
            self.least[place] = n - lacks
            pairs += [(f, place) for f in feature[np.argsort(frequency[feature], kind="stable")[:n]].tolist()]
        feature, self.place = np.array(sorted(pairs)).T
        self.places_at = np.searchsorted(feature, np.arange(len(items.vocabulary) + 1))

    def windows(self, t: Tokens, doc: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """First block, number after the last, and item: all windows that may hold the item by its rarer words."""
        times = np.diff(self.places_at)
        rarer = times[t.feature] > 0
        block, feature = np.divmod(np.unique(t.block[rarer] * len(times) + t.feature[rarer]), len(times))
        n = times[feature]
        place = self.place[np.repeat(self.places_at[feature] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        size = len(doc) + 1, len(self.least)
        upto = np.bincount((np.repeat(block, n) + 1) * size[1] + place, minlength=size[0] * size[1]).astype(np.int32).reshape(size)
        np.cumsum(upto, axis=0, out=upto)
        end = t.blocks[1:][doc]
        for wide, a, b in zip(self.wide.tolist(), self.width_at.tolist(), [*self.width_at[1:].tolist(), size[1]]):
            stop = np.minimum(np.arange(len(doc)) + wide, end)
            at, j = np.nonzero(upto[stop, a:b] - upto[:-1, a:b] >= self.least[a:b])
            yield from zip(at.tolist(), stop[at].tolist(), self.by_width[a + j].tolist())

    def holds(self, item: int, part: list[int]) -> tuple[float, float] | None:
        """Shares of item and answer that are in ``part``, if they are enough."""
        words = self.lists[item]
        hits = list(filter(None, map(self.bits[item].get, part)))
        # a common subsequence has no more words than there are hits, nor than places hit
        if len(hits) / len(words) < self.min_common or reduce(or_, hits, 0).bit_count() / len(words) < self.min_common:
            return None
        share = _common(hits, len(words)) / len(words)
        if share < self.min_common:
            return None
        answer = words[-max(1, len(words) // 4) :]
        end = common_words(answer, part) / len(answer)
        return (share, end) if end >= self.min_answer else None

    def find(self, texts: list[bytes]) -> list[tuple[int, int, float, float, float]]:
        """Number of text, number of item, cosine, shares of item and answer; the best passage of each pair."""
        out = []
        for a, b in chunks(texts):
            t = read(texts[a:b], self.items.vocabulary)
            sums, _ = self.rows.sums(t)
            if not len(sums):
                continue
            doc = np.repeat(np.arange(b - a), np.diff(t.blocks))
            passage = sums.copy()
            follows = np.flatnonzero(doc[1:] == doc[:-1])
            passage[follows] += sums[follows + 1]
            cosine = _unit(passage) @ self.queries
            p, j = np.nonzero(cosine >= self.min_cosine)
            seen: dict[tuple[int, int], tuple[float, float, float]] = {}
            done: set[tuple[int, int, int]] = set()
            for k in np.lexsort((-cosine[p, j], self.of[j], doc[p])).tolist():
                d, i, at = int(doc[p[k]]), int(self.of[j[k]]), int(p[k])
                if (d, i, at) in done:
                    continue
                done.add((d, i, at))
                spare = len(self.lists[i]) + SPARE
                start = int(t.bounds[d]) + (at - int(t.blocks[d])) * BLOCK
                part = t.hashes[max(int(t.bounds[d]), start - spare) : min(int(t.bounds[d + 1]), start + 2 * BLOCK + spare)].tolist()
                if held := self.holds(i, part):
                    seen[d, i] = max(seen.get((d, i), (0.0, 0.0, 0.0)), (held[0], float(cosine[at, j[k]]), held[1]))
            by_words: dict[tuple[int, int], tuple[float, float, float]] = {}
            for at, stop, i in self.windows(t, doc):
                d = int(doc[at])
                if (d, i) in seen:
                    continue
                start = int(t.bounds[d]) - int(t.blocks[d]) * BLOCK
                part = t.hashes[start + at * BLOCK : min(int(t.bounds[d + 1]), start + stop * BLOCK)].tolist()
                if held := self.holds(i, part):
                    by_words[d, i] = max(by_words.get((d, i), (0.0, 0.0, 0.0)), (held[0], float(cosine[at:stop, self.of == i].max()), held[1]))
            seen |= by_words
            out += [(a + d, i, c, s, e) for (d, i), (s, c, e) in seen.items()]
        return out


def prepare(docs: DataFrame, benchmark: DataFrame, rank: int = 240, min_cosine: float = 0.55, min_common: float = 0.7, min_answer: float = 0.5, seed: int = 11, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> Search | None:
    """The search over the latent space of ``docs``; None if no item has a word."""
    items = items_of(benchmark, item_col, item_text_col)
    if not items.words:
        return None
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(items)
    frequency, idf, basis = latent_basis(texts, items, shared, rank, seed)
    return Search(items, frequency, idf, basis, min_cosine, min_common, min_answer)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row for each document and benchmark item that is in it: doc_id, item_id, cosine, common, answer, contaminated (true).

    Null and empty texts hold nothing; items without words are sought nowhere; an
    empty benchmark gives no rows.  Repeated documents, or items, are reported each.
    """
    schema = "doc_id long, item_id long, cosine double, common double, answer double"
    rows = id_and_text(docs, id_col, options.get("text_col", "text"))
    search = prepare(rows, benchmark, **(options | {"text_col": "text"}))
    if search is None:
        return docs.sparkSession.createDataFrame([], schema).withColumn("contaminated", F.lit(True))
    shared = docs.sparkSession.sparkContext.broadcast(search)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = shared.value
        for batch, texts in _texts(batches, 1):
            found = search.find(texts)
            ids = batch.column("doc_id").to_pylist()
            yield pa.record_batch(
                [
                    pa.array([ids[d] for d, *_ in found], pa.int64()),
                    pa.array([search.items.ids[i] for _, i, *_ in found], pa.int64()),
                    *(pa.array([x[k] for x in found], pa.float64()) for k in (2, 3, 4)),
                ],
                names=["doc_id", "item_id", "cosine", "common", "answer"],
            )

    return rows.mapInArrow(run, schema).withColumn("contaminated", F.lit(True))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which ``leaks`` finds no item; the last pass filters them as it goes."""
    search = prepare(docs, benchmark, text_col=text_col, **options)
    if search is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(search)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches, at):
            bad = {d for d, *_ in shared.value.find(texts)}
            yield batch.filter(pa.array([i not in bad for i in range(len(texts))], pa.bool_())) if bad else batch

    return docs.mapInArrow(run, docs.schema)
