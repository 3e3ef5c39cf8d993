"""Token counts of texts by a linear longest-match automaton over a vocabulary.

A word's pieces are, from left to right, always the longest vocabulary entry that the rest of the word starts with. The vocabulary is a
trie. Where a byte has no edge, the node's failure link leads to the node that stands for what is left after the pieces that are certain
by then, and the number of these pieces is stored with the link. So each byte is read once and the count is known without building a
piece. Words are runs of bytes other than the six ASCII spaces, matched with one space in front, as the vocabulary marks starts of words;
every single byte must be in the vocabulary, so no word is unknown.

Counts of distinct words are remembered for up to CACHED_WORDS words per worker (which changes the speed only).

Defined results: null and empty texts have no words and no tokens; rows are counted one by one; extra columns stay; an empty
table gives an empty table.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowlens.llm import kernels as K
from flowlens.llm.exchange import give_rest, keep_rest, tidy
from flowlens.llm.packing import distinct

CACHED_WORDS = 600_000
MADE = ("n_words", "n_tokens")
_counters: dict[str, Counter] = {}


def read_vocabulary(path: str) -> list[bytes]:
    """Entries of a file with a base64 text and a rank per line."""
    with open(path, "rb") as file:
        return [base64.b64decode(line.split()[0]) for line in file if line.strip()]


class Matcher:
    """The automaton. `edge` leads from node * 256 + byte to a node; node 0 is the root."""

    def __init__(self, vocabulary: list[bytes]):
        self.edge: dict[int, int] = {}
        entry, self.fail, self.popped = [False], [0], [0]
        for word in vocabulary:
            node = 0
            for byte in word:
                key = node << 8 | byte
                node = self.edge.get(key)
                if node is None:
                    node = self.edge[key] = len(entry)
                    entry.append(False)
            entry[node] = True
        missing = [b for b in range(256) if b not in self.edge or not entry[self.edge[b]]]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        self.fail, self.popped = [0] * len(entry), [0] * len(entry)
        below: dict[int, list[tuple[int, int]]] = {}
        for key, child in self.edge.items():
            below.setdefault(key >> 8, []).append((key & 255, child))
        level = [0]
        while level:  # breadth first: links lead to shorter strings
            following = []
            for node in level:
                for byte, child in below.get(node, ()):
                    following.append(child)
                    if entry[child]:
                        self.fail[child], self.popped[child] = 0, 1
                        continue
                    at, popped = self.fail[node], self.popped[node]
                    while at << 8 | byte not in self.edge:
                        popped += self.popped[at]
                        at = self.fail[at]
                    self.fail[child], self.popped[child] = self.edge[at << 8 | byte], popped
            level = following

    def count(self, word: bytes) -> int:
        edge, fail, popped = self.edge, self.fail, self.popped
        node = pieces = 0
        for byte in word:
            to = edge.get(node << 8 | byte)
            while to is None:
                pieces += popped[node]
                node = fail[node]
                to = edge.get(node << 8 | byte)
            node = to
        while node:
            pieces += popped[node]
            node = fail[node]
        return pieces


class Counter:
    def __init__(self, path: str):
        self.matcher, self.known = Matcher(read_vocabulary(path)), {}

    def count(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words and tokens of each text."""
        starts, ends, bounds = K.words(data, offsets)
        names, first, number = distinct(
            K.span_hash(K.prefix_sums(K.byte_values(data)), starts, ends) + (ends - starts).astype(np.uint64))
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        each = np.zeros(len(names), np.int64)
        for i, (name, at) in enumerate(zip(names.tolist(), first.tolist(), strict=True)):
            if name not in self.known:
                self.known[name] = self.matcher.count(b" " + data[starts[at]:ends[at]].tobytes())
            each[i] = self.known[name]
        total = np.concatenate([[0], np.cumsum(each[number])])
        return np.diff(bounds), total[bounds[1:]] - total[bounds[:-1]]


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """`docs` (text and any other columns) with n_words and n_tokens. `vocabulary`: a file path, the same on every executor."""
    kept = keep_rest(docs, "text")
    rest = kept.schema["_rest"].dataType.simpleString()

    def run(batches):
        if vocabulary not in _counters:
            _counters[vocabulary] = Counter(vocabulary)
        counter = _counters[vocabulary]
        for batch in batches:
            parts = [counter.count(data, offsets) for _, _, data, offsets in K.chunks(batch.column("text"))]
            made = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts, strict=True)] or [pa.array([], pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("_rest"), *made], ["text", "_rest", *MADE])

    return give_rest(kept.mapInArrow(tidy(run), f"text string, _rest {rest}, n_words long, n_tokens long"), *MADE)
