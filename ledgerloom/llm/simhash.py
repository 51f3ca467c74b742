"""Near-duplicates by SimHash and a binary trie joined with itself.

Fingerprints are laid out as a binary trie, an array sorted by their bits whose
nodes are ranges.  Pairs of nodes are walked down together from the root; the
bits by which the two differ are counted on the way, and a pair is dropped as
soon as it has more than the budget.  A pair whose bits left fit in the budget
needs no further look: all below it are linked.

To divide the work, the bits are cut into budget + 2 blocks.  Two fingerprints
within the budget agree on two blocks at least, so one trie for each value of each
two blocks finds every link.  A task returns a spanning forest of the links in it,
so a group of thousands of copies never becomes millions of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, free_name, id_and_text, let_go, partitions, whole_groups
from .components import components, part_of
from .overlap import FREQUENT, Counts, alike_pairs, blocks_of_two, pairs_in_blocks
from .shingles import shingle_hashes, words_id

BITS = 64
NO_ID = 2**63 - 1
#: Comparisons made at once.
AT_ONCE = 2_000_000
#: Links kept before they are cut down to a forest.
LINKS = 1_000_000


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is in over half of the hashes; no hashes give 0."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = np.ascontiguousarray(hashes[at : at + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


class Forest:
    """Keeps, of links offered in any number, a forest with the fewest bits; its size is bounded by the nodes."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> None:
        if len(a):
            self.parts.append((a, b, bits))
            self.n += len(a)
            if self.n > LINKS:
                self.parts = [self.links()]
                self.n = len(self.parts[0][0])

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return (np.empty(0, np.int64),) * 3
        a, b, bits = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((b, a, bits))
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        kept = []
        for i, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist()):
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                kept.append(i)
        at = np.array(kept, np.int64)
        return a[at], b[at], bits[at]


def trie_links(prints: np.ndarray, group: np.ndarray, budget: int, forest: Forest, rows: np.ndarray) -> None:
    """Adds to ``forest`` the links between equal groups; rows: what a link names by."""
    order = np.lexsort((prints, group))
    f, g, rows = prints[order], group[order], rows[order]
    edge = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
    lo, hi = edge[:-1], edge[1:]
    lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    for at in range(0, len(lo), 4096):
        _walk(f, lo[at : at + 4096], hi[at : at + 4096], budget, forest, rows)


def _walk(f: np.ndarray, lo: np.ndarray, hi: np.ndarray, budget: int, forest: Forest, rows: np.ndarray) -> None:
    # a stack of levels, each a batch of node pairs: first range, second range, bits that differ
    stack = [(BITS - 1, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while stack:
        bit, l1, h1, l2, h2, diff = stack.pop()
        if not len(l1):
            continue
        all_linked = diff + bit + 1 <= budget
        if all_linked.any():
            for a, b, c, d, n in zip(*(x[all_linked].tolist() for x in (l1, h1, l2, h2, diff))):
                chain = np.arange(a, b) if a == c else np.concatenate((np.arange(a, b), np.arange(c, d)))
                forest.add(rows[chain[:-1]], rows[chain[1:]], np.bitwise_count(f[chain[:-1]] ^ f[chain[1:]]).astype(np.int64))
            l1, h1, l2, h2, diff = (x[~all_linked] for x in (l1, h1, l2, h2, diff))
            if not len(l1):
                continue
        work = (h1 - l1) * (h2 - l2)
        few = (work <= (1024 if budget < 8 else 1 << 18)) | (bit < 0)  # with a wide budget the upper bits prune little
        if few.any():
            _compare(f, *(x[few] for x in (l1, h1, l2, h2)), budget, forest, rows)
            l1, h1, l2, h2, diff = (x[~few] for x in (l1, h1, l2, h2, diff))
            if not len(l1):
                continue
        mask = np.uint64(1 << bit)

        def middle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """The first place in each range whose bit is set: a binary search in step."""
            a, b = a.copy(), b.copy()
            while (more := a < b).any():
                m = (a + b) >> 1
                one = (f[np.minimum(m, len(f) - 1)] & mask) != 0
                b = np.where(more & one, m, b)
                a = np.where(more & ~one, m + 1, a)
            return a

        m1, m2 = middle(l1, h1), middle(l2, h2)
        own = l1 == l2
        children = [
            (l1, m1, l2, m2, diff, np.ones(len(l1), bool)),
            (m1, h1, m2, h2, diff, np.ones(len(l1), bool)),
            (l1, m1, m2, h2, diff + 1, np.ones(len(l1), bool)),
            (m1, h1, l2, m2, diff + 1, ~own),
        ]
        for a, b, c, d, n, wanted in children:
            live = wanted & (n <= budget) & (a < b) & (c < d) & ~((a == c) & (b - a < 2))
            for at in range(0, int(live.sum()), 1 << 16):
                at = np.flatnonzero(live)[at : at + (1 << 16)]
                stack.append((bit - 1, a[at], b[at], c[at], d[at], n[at]))


def _compare(f, l1, h1, l2, h2, budget: int, forest: Forest, rows: np.ndarray) -> None:
    """Compares all of one range with all of the other, for many pairs of ranges at once."""
    work = (h1 - l1) * (h2 - l2)
    for a, b, c, d in zip(*(x[work > 4096].tolist() for x in (l1, h1, l2, h2))):
        bits = np.bitwise_count(f[a:b, None] ^ f[None, c:d])
        i, j = np.nonzero(bits <= budget)
        near = bits[i, j].astype(np.int64)
        i, j = i + a, j + c
        once = i < j if a == c else slice(None)
        forest.add(rows[i[once]], rows[j[once]], near[once])
    l1, h1, l2, h2, work = (x[work <= 4096] for x in (l1, h1, l2, h2, work))
    if not len(work):
        return
    cuts = np.searchsorted(np.cumsum(work), np.arange(AT_ONCE, work.sum() + AT_ONCE, AT_ONCE))
    start = 0
    for stop in dict.fromkeys(np.minimum(cuts + 1, len(work)).tolist()):
        w, a, c, wide = work[start:stop], l1[start:stop], l2[start:stop], (h2 - l2)[start:stop]
        own = np.repeat(l1[start:stop] == l2[start:stop], w)
        k = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        wide = np.repeat(wide, w)
        i, j = np.repeat(a, w) + k // wide, np.repeat(c, w) + k % wide
        bits = np.bitwise_count(f[i] ^ f[j])
        near = (bits <= budget) & (~own | (i < j))
        forest.add(rows[i[near]], rows[j[near]], bits[near].astype(np.int64))
        start = stop


def links(prints: DataFrame, budget: int, agree: int = 2, size_ratio: float | None = None) -> DataFrame:
    """a, b (structs of first and fp) and bits: for each trie a spanning forest of the pairs within ``budget`` bits.

    ``prints`` has first and fp, one row a node.  Of budget + ``agree`` blocks two
    nodes within the budget have ``agree`` in common.  With ``size_ratio`` there is also
    size, and only nodes on the same step of a scale of that ratio meet.
    """
    p = partitions(prints.sparkSession)
    blocks = min(budget + agree, BITS)
    ends = [BITS * i // blocks for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(ends, ends[1:])]
    masks = [sum(some) for some in combinations(block, blocks - budget)] if blocks > budget else [0]
    keys = [F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m - (1 << BITS) if m >> (BITS - 1) else m)).alias("value")) for i, m in enumerate(masks)]
    step = F.lit(0) if size_ratio is None else F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / F.log(F.lit(1 / size_ratio)) + F.lit(1e-9)).cast("int")
    rows = prints.select("first", "fp", step.alias("step"), F.explode(F.array(*keys)).alias("k")).select("k.i", "k.value", "step", "first", "fp")
    rows = rows.repartition(p, "i", "value", "step").sortWithinPartitions("i", "value", "step")
    schema = pa.schema([("a_first", pa.int64()), ("a_fp", pa.int64()), ("b_first", pa.int64()), ("b_fp", pa.int64()), ("bits", pa.int32())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in whole_groups(batches, 3):
            group = np.cumsum(np.concatenate(([True], (x[1:, :3] != x[:-1, :3]).any(axis=1))))
            forest = Forest()
            trie_links(np.ascontiguousarray(x[:, 4]).view(np.uint64), group, budget, forest, np.arange(len(x)))
            a, b, bits = forest.links()
            yield pa.record_batch([*(pa.array(np.ascontiguousarray(c)) for c in (x[a, 3], x[a, 4], x[b, 3], x[b, 4])), pa.array(bits.astype(np.int32))], schema=schema)

    out = rows.mapInArrow(join, "a_first long, a_fp long, b_first long, b_fp long, bits int")
    node = lambda s: F.struct(F.col(f"{s}_first").alias("first"), F.col(f"{s}_fp").alias("fp")).alias(s)
    return out.select(node("a"), node("b"), "bits")


def _prints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(t, shingle) for t in as_bytes(batch.column("text"))]
            prints = np.fromiter((fingerprint(h) for h in hashes), np.uint64, len(hashes)).view(np.int64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(prints)], names=["doc_id", "fp"])

    return run


def near_groups(docs: DataFrame, shingle: int = 4, budget: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint and component_id for each row of ``docs``.

    Fingerprints link at ``budget`` or fewer differing bits; component_id is the
    smallest id reachable.  Null and empty texts have fingerprint 0, linked like
    any other.  Repeated rows are returned each.  A null id gives way to any
    other; a component of null ids only has component_id null.
    """
    rows = cut(id_and_text(docs, id_col, text_col).mapInArrow(_prints(shingle), "doc_id long, fp long"))
    rows = rows.withColumn("part", part_of("doc_id"))
    known = F.coalesce("doc_id", F.lit(NO_ID))
    nodes = rows.groupBy("fp", "part").agg(F.min(known).alias("first")).groupBy("fp").agg(F.min("first").alias("first"), F.collect_set("part").alias("parts"))
    label = components(links(nodes.select("first", "fp"), budget)).select(F.col("node.fp").alias("fp"), F.col("label.first").alias("least"))
    found = nodes.join(label, "fp", "left").select("fp", F.explode("parts").alias("part"), F.coalesce("least", "first").alias("component_id"))
    out = rows.join(found, ["fp", "part"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.nullif(F.col("component_id"), F.lit(NO_ID)).alias("component_id"))


def drop_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, budget: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that are linked with a smaller id, over any number of links.

    Two texts are linked if their shingle sets have a Jaccard similarity of
    ``similarity`` or more.  Fingerprints of the sets within ``budget`` bits propose links
    first, in forests, which join large groups cheaply, and with them texts that stand side
    by side in a block of ``overlap``.  Then every text is tried with a few that it is not
    joined with yet, so that few groups are in more than one part when, last, all pairs of
    unlike groups that may be similar enough are tried; so no link between two of the groups
    is lost.  Proposals hold if the sets are.
    Texts of the same words are one node, whose smallest id stays.
    Texts without words are alike.  Null ids go first.  There is one way for every size.
    """
    key = free_name(docs, "text_key")
    own = lambda c: F.xxhash64(F.coalesce(c.cast("string"), F.lit("")))
    slim = id_and_text(docs, id_col, text_col).withColumn("own", own(F.col("text"))).withColumn("id", F.coalesce("doc_id", F.lit(NO_ID)))
    sketched = cut(slim.select("id", "own", "text").mapInArrow(_sketch(shingle), "id long, own long, fp long, same long, size long, counted boolean"))
    rows = sketched.where("not counted").drop("counted").withColumn("part", part_of("id"))
    # nodes: texts of the same words; named by their smallest row
    named = rows.groupBy("same", "part").agg(F.min(F.struct("id", "own", "fp", "size")).alias("m")).groupBy("same").agg(F.min("m").alias("m"), F.collect_set("part").alias("parts"))
    nodes = cut(named.select("same", "parts", F.col("m.id").alias("first"), F.col("m.own").alias("own"), F.col("m.fp").alias("fp"), F.col("m.size").alias("size")))
    proposed = links(nodes.select(F.col("same").alias("first"), "fp", "size"), budget, size_ratio=similarity)
    proposed = proposed.select(F.least("a.first", "b.first").alias("a"), F.greatest("a.first", "b.first").alias("b"))
    name = nodes.select("same", F.struct("first", "same").alias("node"))

    def holding(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` that are similar enough, by names that sort by the smallest id; only texts of a pair are read."""
        wanted = pairs.select(F.col("a").alias("same")).union(pairs.select("b")).distinct()
        wanted = nodes.join(wanted, "same", "left_semi").select("same", F.col("first").alias("id"), "own")
        sets = slim.select("id", "own", "text").join(wanted.hint("merge"), ["id", "own"]).select("same", "text").mapInArrow(_sets(shingle), "same long, shingles binary")
        sets = cut(sets.groupBy("same").agg(F.first("shingles").alias("shingles")))  # repeated rows as one
        let_go(docs.sparkSession)
        ab = alike_pairs(pairs, sets, similarity)
        ab = ab.join(name.withColumnsRenamed({"same": "a", "node": "na"}), "a").join(name.withColumnsRenamed({"same": "b", "node": "nb"}), "b")
        return cut(ab.select(F.col("na").alias("a"), F.col("nb").alias("b")))

    blocks = cut(blocks_of_two(slim, _frequent(sketched), shingle, similarity))
    let_go(docs.sparkSession)
    tested = cut(proposed.union(pairs_in_blocks(blocks, None, similarity, turn=0)).distinct())
    label = cut(components(holding(tested)))
    for turn in (1, None):  # a few pairs of each text that are not joined yet, then all
        let_go(docs.sparkSession)
        found = pairs_in_blocks(blocks, label.select(F.col("node.same").alias("same"), F.col("label.same").alias("label")), similarity, turn)
        found = cut(found.join(tested, ["a", "b"], "left_anti"))
        if found.isEmpty():
            continue
        tested = tested.union(found)
        more = holding(found)
        if not more.isEmpty():
            label = cut(components(label.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more)))
    let_go(docs.sparkSession)
    gone_nodes = label.where("node <> label").select(F.col("node.same").alias("same"))
    lost = rows.join(nodes.select("same", F.explode("parts").alias("part"), "first", F.col("own").alias("first_own")), ["same", "part"])
    lost = lost.join(gone_nodes.withColumn("whole", F.lit(True)), "same", "left")
    lost = lost.where("whole or id <> first or own <> first_own")
    lost_id, lost_own = free_name(docs, "lost_id"), free_name(docs, "lost_own")
    lost = lost.select(F.nullif(F.col("id"), F.lit(NO_ID)).alias(lost_id), F.col("own").alias(lost_own)).distinct()
    marked = docs.withColumn(key, own(F.col(text_col)))
    return marked.join(lost.hint("merge"), marked[id_col].cast("long").eqNullSafe(lost[lost_id]) & (marked[key] == lost[lost_own]), "left_anti").drop(key)


def _sketch(shingle: int):
    """Fingerprint, name and size of each shingle set; at a task's end also its most frequent shingles (counted; id: the shingle, size: its number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "own", "fp", "same", "size", "counted"]
        counts = Counts()
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            hashes = [np.unique(shingle_hashes(t, shingle)) for t in texts]
            counts.add(hashes)
            prints = np.fromiter((fingerprint(h) for h in hashes), np.uint64, len(hashes)).view(np.int64)
            same = np.fromiter(map(words_id, texts), np.uint64, len(texts)).view(np.int64)
            sizes = pa.array([len(h) for h in hashes], pa.int64())
            yield pa.record_batch([batch.column("id"), batch.column("own"), pa.array(prints), pa.array(same), sizes, pa.array(np.zeros(len(texts), bool))], names=names)
        value, n = counts.most()
        zero = pa.array(np.zeros(len(value), np.int64))
        yield pa.record_batch([pa.array(value.view(np.int64)), zero, zero, zero, pa.array(n), pa.array(np.ones(len(value), bool))], names=names)

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in as_bytes(batch.column("text"))]
            yield pa.record_batch([batch.column("same"), pa.array(found, pa.binary())], names=["same", "shingles"])

    return run


def _frequent(sketched: DataFrame) -> np.ndarray:
    """The most frequent shingles of all texts, at most FREQUENT, the most frequent first.  Only the order of prefixes rests on them."""
    counts = sketched.where("counted").groupBy(F.col("id").alias("h")).agg(F.sum("size").alias("n")).withColumn("level", F.floor(F.log2("n") * 8).cast("int"))
    counts = cut(counts)
    least, n = 10**6, 0
    for r in sorted(counts.groupBy("level").agg(F.count(F.lit(1)).alias("m")).collect(), reverse=True):  # a few hundred levels
        n += r.m
        if n > FREQUENT:
            break
        least = r.level
    top = counts.where(F.col("level") >= least).select("h", "n").toArrow()
    h, n = (top.column(c).combine_chunks().to_numpy() for c in ("h", "n"))
    return h[np.lexsort((h, -n))].view(np.uint64)
