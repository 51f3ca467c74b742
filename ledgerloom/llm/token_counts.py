"""Numbers of greedy longest-match word pieces, counted without making the pieces.

The vocabulary is a trie over bytes.  A node that no piece ends at has a failure
link: the node that stands for the rest once the longest pieces have been taken
off its front; how many were taken off is known beforehand.  Reading a word then
needs one step a byte and one link for each piece or so.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, id_and_text

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words whose counts a worker remembers; then it starts over.
MEMO = 200_000


def read_pieces(path: str) -> list[bytes]:
    """The pieces of a file of lines of base64 and rank.  A piece that starts a word starts with a space."""
    with open(path, "rb") as lines:
        return [base64.b64decode(x.split()[0]) for x in lines if x.strip()]


class Automaton:
    """step: (node << 8 | byte) -> node; link, popped: by node.  Node 0 is the root, link -1 means none."""

    def __init__(self, pieces: list[bytes]):
        self.step: dict[int, int] = {}
        ends, parent = [False], [(0, 0)]
        for piece in pieces:
            node = 0
            for byte in piece:
                key = node << 8 | byte
                below = self.step.get(key)
                if below is None:
                    below = self.step[key] = len(ends)
                    ends.append(False)
                    parent.append((node, byte))
                node = below
            ends[node] = True
        depth = [0] * len(ends)
        for v in range(1, len(ends)):  # a node is made after its parent
            depth[v] = depth[parent[v][0]] + 1
        self.link, self.popped = [-1] * len(ends), [0] * len(ends)
        for v in sorted(range(1, len(ends)), key=depth.__getitem__):
            if ends[v]:
                self.link[v], self.popped[v] = 0, 1
                continue
            up, byte = parent[v]
            z, n = self.link[up], self.popped[up]
            while z >= 0 and (z << 8 | byte) not in self.step:
                n, z = n + self.popped[z], self.link[z]
            if z >= 0:
                self.link[v], self.popped[v] = self.step[z << 8 | byte], n

    def count(self, word: bytes) -> int:
        """Pieces of ``word``; a word that cannot be cut into pieces counts as one unknown piece."""
        step, link, popped = self.step, self.link, self.popped
        node = n = 0
        for byte in word:
            while (below := step.get(node << 8 | byte)) is None:
                n += popped[node]
                node = link[node]
                if node < 0:
                    return 1
            node = below
        while node > 0:
            n += popped[node]
            node = link[node]
        return 1 if node < 0 else n


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and n_tokens for each row of ``docs``.

    Words are runs of anything but ASCII white space, each read with a space in
    front.  Null and empty texts have no words; repeated rows are counted each.
    The vocabulary is read on the driver and broadcast; its size does not depend
    on the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(read_pieces(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, memo = shared.value.count, {}
        for batch in batches:
            words_of, tokens_of = [], []
            for text in as_bytes(batch.column("text")):
                words, n = text.split(), 0
                for w in words:
                    k = memo.get(w)
                    if k is None:
                        k = count(b" " + w)
                        if len(memo) >= MEMO:
                            memo.clear()
                        if len(w) <= 64:
                            memo[w] = k
                    n += k
                words_of.append(len(words))
                tokens_of.append(n)
            yield pa.record_batch([batch.column("doc_id"), pa.array(words_of, pa.int64()), pa.array(tokens_of, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
