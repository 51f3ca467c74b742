"""Removal of word passages that occur twice, on a compacted de Bruijn graph.

An edge of the graph is a k-mer of words, leading from its first k - 1 words to its
last.  ``anchors`` leaves the edges that may be repeated, a few in a row at a time,
dealt to shards.  A shard counts each edge and knows its neighbours; repeated
edges in a row that are never entered or left elsewhere become one segment.
Joins of the segments with each other, in which every segment leaps to where its
predecessor points, then compact whole nonbranching paths.  Batches of documents
learn which segments they have where, and from the compacted graph the path, the
place on it and the length of each: that gives the spans at their source
coordinates.  The words of every span are read there again, and 128 further bits
made of them; only spans whose words are met a second time so are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import NO_ID, among, chunks, dealt, mixed, places_of, ranges, read, rolling, runs, shared_anchors, span_prints, word_tokens
from .common import cut

#: In place of a neighbouring edge: the document ends there; there are several.
END, BRANCH = 0, 1
_FOUND = "batch int, content long, offset int, n int, head long, tail long, count long, pred long, succ long"


def _edges(tokens: np.ndarray, window: int) -> np.ndarray:
    return mixed(rolling(tokens, window)) if len(tokens) >= window else np.empty(0, np.uint64)


def _one_or_branch(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The value of each group, or BRANCH if it has more than one."""
    least = np.minimum.reduceat(values, first)
    return np.where(least == np.maximum.reduceat(values, first), least, np.uint64(BRANCH))


def _segments(docs: DataFrame, window: int, k: int, id_col: str, text_col: str):
    """The documents by batch; rows of segments (batch -1) and of their places in the pieces of each batch."""
    rows, plan = dealt(docs, window, k, id_col, text_col)
    places = shared_anchors(rows, plan, word_tokens, other_document=False)
    shard_keys = np.array(plan.shards, np.int32)
    schema = pa.schema([("shard", pa.int32()), ("batch", pa.int32()), *((c, pa.binary()) for c in ("content", "anchor", "times", "before", "after", "n", "edges"))])

    def pieces(t: pa.Table, known: pa.Table) -> pa.Table:
        if not t.num_rows:
            return schema.empty_table()
        places = places_of(known)
        _, texts = read(t)
        got, edges = [], []
        base = 0
        for a, b in chunks(texts) if len(places) else ():
            toks, bounds, _ = word_tokens(texts[a:b])
            r = runs(toks, bounds, k, window)
            hit, _ = among(plan.place(r.anchor), places)
            hit = np.flatnonzero(hit)
            if not len(hit):
                continue
            edge = _edges(toks, window)
            start, n, doc = r.start[hit], r.n[hit], r.doc[hit]
            before = np.where(start > bounds[doc], edge[np.maximum(start - 1, 0)], np.uint64(END))
            after = np.where(start + n <= bounds[doc + 1] - window, edge[np.minimum(start + n, len(edge) - 1)], np.uint64(END))
            got.append([r.content[hit], r.anchor[hit], before, after, base + start, n])
            edges.append(edge)
            base += len(edge)
        if not got:
            return schema.empty_table()
        content, anchor, before, after, start, n = (np.concatenate(x) for x in zip(*got))
        edge = np.concatenate(edges)
        order = np.lexsort((content, anchor))
        content = content[order]
        first = np.flatnonzero(np.concatenate(([True], content[1:] != content[:-1])))
        times = np.diff(np.append(first, len(content))).astype(np.int64)
        before, after = _one_or_branch(before[order], first), _one_or_branch(after[order], first)
        content, anchor, start, n = content[first], anchor[order[first]], start[order[first]], n[order[first]]
        at = np.searchsorted(plan.place(anchor) >> np.uint64(32), np.arange(len(shard_keys) + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(at))
        cuts = [slice(at[i], at[i + 1]) for i in some]
        return pa.table(
            [
                pa.array(shard_keys[some]),
                pa.array([t.column("batch")[0].as_py()] * len(some), pa.int32()),
                *(pa.array([x[c].tobytes() for c in cuts], pa.binary()) for x in (content, anchor, times, before, after, n.astype(np.uint8))),
                pa.array([edge[ranges(start[c], n[c])].tobytes() for c in cuts], pa.binary()),
            ],
            schema=schema,
        )

    def count(t: pa.Table) -> pa.Table:
        column = lambda name, kind: [np.frombuffer(x, kind) for x in t.column(name).to_pylist()]
        content = column("content", np.uint64)
        of = np.repeat(np.arange(len(content)), [len(x) for x in content])
        content = np.concatenate(content)
        anchor, times, before, after, n, edges = (np.concatenate(column(c, kind)) for c, kind in (("anchor", np.uint64), ("times", np.int64), ("before", np.uint64), ("after", np.uint64), ("n", np.uint8), ("edges", np.uint64)))
        n = n.astype(np.int64)
        begin = np.cumsum(n) - n
        # equal pieces of all batches as one
        order = np.argsort(content, kind="stable")
        first = np.concatenate(([True], content[order][1:] != content[order][:-1]))
        piece = np.empty(len(content), np.int64)
        piece[order] = np.cumsum(first) - 1
        first = np.flatnonzero(first)
        one = order[first]
        times = np.add.reduceat(times[order], first)
        before, after = _one_or_branch(before[order], first), _one_or_branch(after[order], first)
        wide, edge = n[one], edges[ranges(begin[one], n[one])]
        window_at = np.cumsum(wide) - wide
        owner = np.repeat(np.arange(len(one)), wide)
        pred, succ = np.roll(edge, 1), np.roll(edge, -1)
        pred[window_at], succ[window_at + wide - 1] = before, after
        # each edge over all pieces
        order = np.lexsort((edge, anchor[one][owner]))
        new = np.concatenate(([True], (edge[order][1:] != edge[order][:-1]) | (anchor[one][owner][order][1:] != anchor[one][owner][order][:-1])))
        group = np.empty(len(edge), np.int64)
        group[order] = np.cumsum(new) - 1
        new = np.flatnonzero(new)
        total = np.add.reduceat(times[owner][order], new)[group]
        pred, succ = _one_or_branch(pred[order], new)[group], _one_or_branch(succ[order], new)[group]
        # segments: runs of repeated edges, each the only way on
        repeated = total > 1
        goes_on = np.zeros(len(edge), bool)
        goes_on[1:] = (owner[1:] == owner[:-1]) & repeated[1:] & repeated[:-1] & (succ[:-1] == edge[1:]) & (pred[1:] == edge[:-1]) & (total[1:] == total[:-1])
        # an edge that starts a segment in one piece, as where a run was cut, does so in all
        starts = np.zeros(len(new), bool)
        starts[group[repeated & ~goes_on]] = True
        goes_on &= ~starts[group]
        head = np.flatnonzero(repeated & ~goes_on)
        stop = np.flatnonzero(repeated & ~np.append(goes_on[1:], False))
        size = stop - head + 1
        _, own = np.unique(edge[head], return_index=True)
        signed = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
        none = pa.array(np.zeros(len(own), np.int64))
        graph = pa.table(
            [pa.array(np.full(len(own), -1, np.int32)), none, none.cast(pa.int32()), pa.array(size[own].astype(np.int32)), signed(edge[head[own]]), signed(edge[stop[own]]), pa.array(total[head[own]]), signed(pred[head[own]]), signed(succ[stop[own]])],
            names=_NAMES,
        )
        # and where each batch has them
        per = np.bincount(owner[head], minlength=len(one))
        from_ = np.cumsum(per) - per
        take = ranges(from_[piece], per[piece])
        times_of = np.repeat(np.arange(len(piece)), per[piece])
        batch = t.column("batch").combine_chunks().to_numpy()
        zero = pa.array(np.zeros(len(take), np.int64))
        where = pa.table(
            [pa.array(batch[of[times_of]].astype(np.int32)), signed(content[times_of]), pa.array((head[take] - window_at[owner[head[take]]]).astype(np.int32)), zero.cast(pa.int32()), signed(edge[head[take]]), zero, zero, zero, zero],
            names=_NAMES,
        )
        return pa.concat_tables([graph, where])

    found = rows.groupBy("batch").cogroup(places.groupBy("batch")).applyInArrow(pieces, "shard int, batch int, content binary, anchor binary, times binary, before binary, after binary, n binary, edges binary")
    return rows, cut(found.repartition(plan.p, "shard").groupBy("shard").applyInArrow(count, _FOUND))


_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def compacted(segments: DataFrame) -> DataFrame:
    """head, n, count, path and place: the nonbranching path that each segment is on, and how many edges stand before it there.

    Every round doubles how far a segment sees back.  A path is named by its first
    edge; one that closes on itself, by its least.
    """
    s = segments.select("head", "tail", "n", "count", "pred", "succ")
    before = s.select(F.col("succ").alias("head"), F.col("tail").alias("pred"), "count", F.col("head").alias("up"), F.col("n").cast("long").alias("dist"))
    linked = s.where(~F.col("pred").isin(END, BRANCH)).select("head", "pred", "count").join(before, ["head", "pred", "count"])
    linked = cut(linked.select("head", "up", "dist", F.least("head", "up").alias("low")))
    rounds = 0
    while True:
        far = linked.select(F.col("head").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("dist2"), F.col("low").alias("low2"))
        moved = linked.join(far, "up", "left")
        left = moved.where("up2 is not null").count()
        if not left or 2**rounds > 2 * linked.count():  # what still moves then goes round a circle
            break
        linked = cut(moved.select("head", F.coalesce("up2", "up").alias("up"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"), F.least("low", F.coalesce("low2", "low")).alias("low")))
        rounds += 1
    circle = F.col("up2").isNotNull()
    moved = moved.select("head", F.when(circle, F.col("low")).otherwise(F.col("up")).alias("path"), F.when(circle, F.lit(0)).otherwise(F.col("dist")).alias("place"))
    out = s.select("head", "n", "count").join(moved, "head", "left")
    return out.select("head", "n", "count", F.coalesce("path", "head").alias("path"), F.coalesce("place", F.lit(0)).cast("long").alias("place"))


def repeated_paths(docs: DataFrame, window: int = 35, k: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The compacted graph: path, its number of edges (k-mers of ``window`` words), and how often its edges occur."""
    _, found = _segments(docs, window, k, id_col, text_col)
    return compacted(found.where("batch = -1")).groupBy("path").agg(F.sum("n").alias("n_edges"), F.max("count").alias("times"))


class _Spans:
    """Where the segments that a batch has been told of stand in some of its texts, and the prints of their words."""

    def __init__(self, told: pa.Table, window: int, k: int):
        columns = {c: told.column(c).combine_chunks().to_numpy().copy() for c in told.column_names if c != "batch"}
        columns["content"] = columns["content"].view(np.uint64)
        order = np.lexsort((columns["offset"], columns["content"]))
        self.told = {c: x[order] for c, x in columns.items()}
        content = self.told["content"]
        self.first = np.flatnonzero(np.concatenate(([True], content[1:] != content[:-1]))) if len(content) else np.empty(0, np.int64)
        self.per = np.diff(np.append(self.first, len(content)))
        self.known = content[self.first]
        self.window, self.k = window, k

    def find(self, toks: np.ndarray, bounds: np.ndarray, words: tuple) -> tuple[np.ndarray, ...]:
        """Of each place: first and last word but one, document, row of ``told``, and two numbers made of the words."""
        r = runs(toks, bounds, self.k, self.window)
        hit, at = among(r.content, self.known)
        hit = np.flatnonzero(hit)
        at = at[hit]
        take = ranges(self.first[at], self.per[at])
        run = np.repeat(hit, self.per[at])
        start = r.start[run] + self.told["offset"][take]
        stop = start + self.told["n"][take] + self.window - 1
        fits = stop <= bounds[r.doc[run] + 1]
        start, stop, run, take = start[fits], stop[fits], run[fits], take[fits]
        return start, stop, r.doc[run], take, *span_prints(toks, words, start, stop)


def remove_passages(docs: DataFrame, window: int = 35, k: int = 16, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """What is left of each document without the passages of ``window`` words that also start anywhere else.

    Columns: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one
    space), n_spans (runs of removed words), n_paths (graph paths they lie on), and
    with ``keep_text`` also kept, the words themselves.  Passages are judged on the
    input, and the same document counts as elsewhere.  Null and empty texts have no
    words.  Repeated rows are copies of one another.
    """
    rows, found = _segments(docs, window, k, id_col, text_col)
    graph = compacted(found.where("batch = -1")).select("head", F.col("n").cast("long").alias("n"), "path", "place")
    told = found.where("batch >= 0").select("batch", "content", "offset", "head").join(graph, "head").select("batch", "content", "offset", "head", "n", "path", "place")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("n_spans", pa.int64()), ("n_paths", pa.int64()), *([("kept", pa.string())] if keep_text else [])])
    seen_schema = pa.schema([(c, pa.int64()) for c in ("head", "p1", "p2", "times")])

    def seen(t: pa.Table, told: pa.Table) -> pa.Table:
        """What words the segments have in this batch, and how often."""
        if not t.num_rows or not told.num_rows:
            return seen_schema.empty_table()
        _, texts = read(t)
        spans, got = _Spans(told, window, k), []
        for a, b in chunks(texts):
            toks, bounds, words = word_tokens(texts[a:b])
            _, _, _, take, p1, p2 = spans.find(toks, bounds, words)
            got.append(np.stack((spans.told["head"][take], p1.view(np.int64), p2.view(np.int64)), axis=1))
        x, times = np.unique(np.concatenate(got), axis=0, return_counts=True)
        return pa.table([*(pa.array(np.ascontiguousarray(c)) for c in x.T), pa.array(times.astype(np.int64))], schema=seen_schema)

    def cleaned(t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows:
            return schema.empty_table()
        ids, texts = read(t)
        spans = _Spans(told, window, k)
        out: list[tuple] = []
        for a, b in chunks(texts):
            toks, bounds, words = word_tokens(texts[a:b])
            gone = np.zeros(len(toks) + 1, np.int64)
            lies = np.zeros(b - a, np.int64)
            if len(spans.known):
                start, stop, doc, take, p1, p2 = spans.find(toks, bounds, words)
                good = (p1.view(np.int64) == spans.told["p1"][take]) & (p2.view(np.int64) == spans.told["p2"][take])
                start, stop, doc, path = start[good], stop[good], doc[good], spans.told["path"][take][good]
                np.add.at(gone, start, 1)
                np.add.at(gone, stop, -1)
                pairs = np.unique(np.stack((doc, path), 1), axis=0) if len(doc) else np.empty((0, 2), np.int64)
                lies = np.bincount(pairs[:, 0], minlength=b - a)
            gone = np.cumsum(gone[:-1]) > 0
            for i in range(a, b):
                x, y = int(bounds[i - a]), int(bounds[i - a + 1])
                mask = gone[x:y]
                words_left = texts[i].split()
                n = int(mask.sum())
                if n:
                    words_left = [w for w, m in zip(words_left, mask.tolist()) if not m]
                left = b" ".join(words_left)
                runs_gone = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if n else 0
                out.append((None if ids[i] == NO_ID else int(ids[i]), y - x, n, hashlib.sha256(left).hexdigest(), runs_gone, int(lies[i - a]), *([left.decode("utf-8", "replace")] if keep_text else [])))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    by_words = rows.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(seen, "head long, p1 long, p2 long, times long")
    twice = by_words.groupBy("head", "p1", "p2").agg(F.sum("times").alias("times")).where("times > 1").drop("times")
    told = told.join(twice, "head")
    columns = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_spans long, n_paths long" + (", kept string" if keep_text else "")
    return rows.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(cleaned, columns)
