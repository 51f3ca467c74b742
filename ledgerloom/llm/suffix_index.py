"""Removal of long byte strings that an earlier document has, by a family of suffix arrays.

``anchors`` leaves the pieces of text that may hold such strings, dealt to shards.
A shard takes its pieces in batches.  A new batch gets a suffix array, its
suffixes sorted as far as a match must reach; it is merged with the array of the
level of its own size if there is one, and so on up, so that sizes grow
geometrically and every suffix is merged a logarithmic number of times.  A merge
scans both arrays side by side: suffixes that agree on the whole length of a match
stand together, and all of them learn the smallest document among them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchors import NO_ID, among, among_two, byte_tokens, chunks, dealt, places_of, ranges, read, runs, shared_anchors

#: Suffixes of a new batch.
BATCH = 1 << 17


def packed(text: np.ndarray) -> bytes:
    """Text as it is shuffled: closer than the shuffle's own compression."""
    return len(text).to_bytes(8, "little") + pa.compress(text.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


class SuffixIndex:
    """Suffix arrays over ``text``; ``best`` is what each suffix knows so far, by suffix."""

    def __init__(self, text: np.ndarray, at: np.ndarray, best: np.ndarray, length: int):
        # no byte of UTF-8 is 0xFF, and numpy's byte strings must not end in 0
        text = np.where(text == 0, np.uint8(0xFF), text) if len(text) and text.min() == 0 else text
        self.windows = np.lib.stride_tricks.sliding_window_view(text, length) if len(text) >= length else None
        self.at, self.best, self.length = at, best, length
        self.levels: list[np.ndarray | None] = []

    def _sorted(self, suffixes: np.ndarray) -> np.ndarray:
        """Sorts, in which runs that are sorted already are merged only, and scans for matches."""
        keys = np.ascontiguousarray(self.windows[self.at[suffixes]]).view(f"S{self.length}").ravel()
        order = np.argsort(keys, kind="stable")
        keys, suffixes = keys[order], suffixes[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        least = np.minimum.reduceat(self.best[suffixes], first)
        self.best[suffixes] = np.repeat(least, np.diff(np.append(first, len(suffixes))))
        return suffixes

    def add(self, suffixes: np.ndarray) -> None:
        array = self._sorted(suffixes)
        level = 0
        while level < len(self.levels) and (other := self.levels[level]) is not None:
            array = self._sorted(np.concatenate((other, array)))
            self.levels[level] = None
            level += 1
        self.levels[level : level + 1] = [array]

    def close(self) -> np.ndarray:
        """Merges what levels are left; then every suffix knows all of its matches."""
        array = None
        for level in self.levels:
            if level is not None:
                array = level if array is None else self._sorted(np.concatenate((level, array)))
        return self.best


def remove_repeats(docs: DataFrame, length: int = 50, k: int = 20, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """What is left of each document without strings of ``length`` bytes that start in one with a smaller id.

    Columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with
    ``keep_bytes`` also kept, the bytes themselves (a cut may fall inside a
    character).  Strings are judged on the input.  Null text counts as empty.
    Documents of one id, repeated rows among them, remove nothing from one
    another.  Documents without an id come after all others, and remove nothing
    from one another.
    """
    rows, plan = dealt(docs, length, k, id_col, text_col)
    places = shared_anchors(rows, plan, byte_tokens, other_document=True)
    shard_keys = np.array(plan.shards, np.int32)

    def pieces(t: pa.Table, known: pa.Table) -> pa.Table:
        """For each shard the different pieces of the batch that may be elsewhere: 128 bits of their content, least and largest id, windows, bytes."""
        if not t.num_rows:
            return pieces_schema.empty_table()
        places = places_of(known)
        ids, texts = read(t)
        got: list[list[np.ndarray]] = []
        whole, base = [], 0
        for a, b in chunks(texts) if len(places) else ():
            toks, bounds, raw = byte_tokens(texts[a:b])
            r = runs(toks, bounds, k, length, both=True)
            hit, _ = among(plan.place(r.anchor), places)
            if hit.any():
                got.append([r.content[hit], r.content2[hit], plan.place(r.anchor[hit]) >> np.uint64(32), ids[a + r.doc[hit]], base + r.start[hit], r.n[hit]])
                whole.append(raw)
                base += len(raw)
        if not got:
            return pieces_schema.empty_table()
        content, content2, shard, whose, start, n = (np.concatenate(x) for x in zip(*got))
        raw = np.concatenate(whole)
        order = np.lexsort((whose, content2, content, shard))
        content, content2, shard, whose = content[order], content2[order], shard[order], whose[order]
        first = np.flatnonzero(np.concatenate(([True], (content[1:] != content[:-1]) | (content2[1:] != content2[:-1]))))
        last = np.append(first[1:], len(content)) - 1
        least, most = whose[first], whose[last]
        content, content2, shard, start, n = content[first], content2[first], shard[first], start[order[first]], n[order[first]]
        edge = np.searchsorted(shard, np.arange(len(shard_keys) + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(edge))
        cut = [slice(edge[i], edge[i + 1]) for i in some]
        return pa.table(
            [
                pa.array(shard_keys[some]),
                pa.array([t.column("batch")[0].as_py()] * len(some), pa.int32()),
                *(pa.array([x[c].tobytes() for c in cut], pa.binary()) for x in (content, content2, least, most - least, n.astype(np.uint8))),
                pa.array([packed(raw[ranges(start[c], n[c] + length - 1)]) for c in cut], pa.binary()),
            ],
            schema=pieces_schema,
        )

    def matches(t: pa.Table) -> pa.Table:
        """For each batch what its pieces learn: 128 bits of the content, number of parts; of each part its first window and the least id that has it."""
        column = lambda name, kind: [np.frombuffer(x, kind) for x in t.column(name).to_pylist()]
        content, content2, least, most, n = column("content", np.uint64), column("content2", np.uint64), column("least", np.int64), column("most", np.int64), column("n", np.uint8)
        of = np.repeat(np.arange(len(content)), [len(x) for x in content])
        content, content2, least, most, n = np.concatenate(content), np.concatenate(content2), np.concatenate(least), np.concatenate(most), np.concatenate(n).astype(np.int64)
        most = least + most  # most pieces are in one document of their batch, so the difference packs well
        text = np.frombuffer(b"".join(map(unpacked, t.column("bytes").to_pylist())), np.uint8)
        begin = np.cumsum(n + length - 1) - (n + length - 1)
        order = np.lexsort((least, content2, content))
        first = np.concatenate(([True], (content[order][1:] != content[order][:-1]) | (content2[order][1:] != content2[order][:-1])))
        one = order[first]  # of equal pieces the one with the least id is indexed
        piece = np.empty(len(content), np.int64)
        piece[order] = np.cumsum(first) - 1
        wide = n[one]
        index = SuffixIndex(text, ranges(begin[one], wide), np.repeat(least[one], wide), length)
        for at in range(0, len(index.at), BATCH):
            index.add(np.arange(at, min(at + BATCH, len(index.at))))
        best = index.close()
        # parts of a piece with one least id
        window = np.cumsum(wide) - wide
        new = np.ones(len(best), bool)
        new[1:] = best[1:] != best[:-1]
        new[window] = True
        part = np.flatnonzero(new)
        owner = np.repeat(np.arange(len(one)), wide)[part]
        parts = np.bincount(owner, minlength=len(one))
        offset, value = (part - window[owner]).astype(np.uint8), best[part]
        part_begin = np.cumsum(parts) - parts
        low = np.minimum.reduceat(best, window) if len(window) else best
        told = np.flatnonzero(low[piece] < most)
        batch = t.column("batch").combine_chunks().to_numpy()
        out = []
        edges = np.searchsorted(of[told], np.arange(t.num_rows + 1))
        for i in range(t.num_rows):
            mine = told[edges[i] : edges[i + 1]]
            if len(mine):
                take = ranges(part_begin[piece[mine]], parts[piece[mine]])
                out.append((int(batch[i]), content[mine].tobytes(), content2[mine].tobytes(), parts[piece[mine]].astype(np.uint8).tobytes(), offset[take].tobytes(), value[take].tobytes()))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), told_schema)], schema=told_schema) if out else told_schema.empty_table()

    def cleaned(t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows:
            return out_schema.empty_table()
        ids, texts = read(t)
        column = lambda name, kind: np.frombuffer(b"".join(told.column(name).to_pylist()), kind)
        content, content2, parts, offset, value = column("content", np.uint64), column("content2", np.uint64), column("parts", np.uint8).astype(np.int64), column("offset", np.uint8).astype(np.int64), column("value", np.int64)
        begin = np.cumsum(parts) - parts
        order = np.lexsort((content2, content))
        content, content2, parts, begin = content[order], content2[order], parts[order], begin[order]
        sha, removed, spans, kept = [], [], [], []
        for a, b in chunks(texts):
            toks, bounds, raw = byte_tokens(texts[a:b])
            gone = np.zeros(len(raw) + 1, np.int64)
            if len(content):
                r = runs(toks, bounds, k, length, both=True)
                hit, at = among_two(r.content, r.content2, content, content2)
                hit = np.flatnonzero(hit)
                at = at[hit]
                take = ranges(begin[at], parts[at])
                run = np.repeat(hit, parts[at])
                from_ = offset[take]
                to = np.append(from_[1:], 0)
                last = np.cumsum(parts[at]) - 1
                to[last] = r.n[hit]
                flagged = value[take] < ids[a + r.doc[run]]
                start = r.start[run][flagged]
                np.add.at(gone, start + from_[flagged], 1)
                np.add.at(gone, start + to[flagged] + length - 1, -1)
            gone = np.cumsum(gone[:-1]) > 0
            for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                mask = gone[x:y]
                left = raw[x:y][~mask].tobytes() if mask.any() else raw[x:y].tobytes()
                sha.append(hashlib.sha256(left).hexdigest())
                removed.append(y - x - len(left))
                spans.append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()) if removed[-1] else 0)
                if keep_bytes:
                    kept.append(left)
        columns = [pa.array(ids, mask=ids == NO_ID), pa.array([len(x) for x in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha)]
        return pa.table([*columns, *([pa.array(kept, pa.binary())] if keep_bytes else [])], schema=out_schema)

    pieces_schema = pa.schema([("shard", pa.int32()), ("batch", pa.int32()), *((c, pa.binary()) for c in ("content", "content2", "least", "most", "n", "bytes"))])
    told_schema = pa.schema([("batch", pa.int32()), *((c, pa.binary()) for c in ("content", "content2", "parts", "offset", "value"))])
    out_schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.binary())] if keep_bytes else [])])
    found = rows.groupBy("batch").cogroup(places.groupBy("batch")).applyInArrow(pieces, "shard int, batch int, content binary, content2 binary, least binary, most binary, n binary, bytes binary")
    told = found.repartition(plan.p, "shard").groupBy("shard").applyInArrow(matches, "batch int, content binary, content2 binary, parts binary, offset binary, value binary")
    columns = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_bytes else "")
    return rows.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(cleaned, columns)
