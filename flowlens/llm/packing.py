"""Packing of tokenised documents into sequences by bounded-space online best fit.

Each scan task keeps `open_windows` windows. A document's ids are cut into whole sequences; its tail goes to the open window with
the least room that holds it. When none does and no further window may open, the fullest window is emitted: a gap of
`least_cut` ids or more is filled by a cut of the tail, a smaller one is padded. What stays open at the end of the tasks is merged in
rounds of `merge_parts` tasks: the fullest window takes ids from the emptiest until it is full, so a round leaves one
window per group, and one window of the whole table is not full.

Memory: the ids of one document, of the open windows, and a bounded table of units already tokenised. The tokenizer files
this is for lower-case a text and encode its runs of letters, its digits and its runs of other signs one by one, so a
text's ids are those of its units one after another, which `units` finds.

Defined results: a null or empty text is the closing id alone; every row is packed, also repeated ones; the result depends on the
order of rows in the scan tasks, which is the same whenever a task runs again; extra columns are not read; an empty table gives an
empty table.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlens.llm import kernels as K
from flowlens.llm.exchange import staged, tidy

LENGTH = 2048
END_ID = 1
OPEN_WINDOWS = 32
LEAST_CUT = 16
MERGE_PARTS = 16
CACHED_WORDS = 600_000

# Bytes by kind: space, letter, digit, other sign, and bytes that only the tokenizer itself judges.
SPACE, LETTER, DIGIT, SIGN, ODD = range(5)
KIND = np.full(256, ODD, np.uint8)
KIND[33:127] = SIGN
KIND[48:58] = DIGIT
KIND[65:91] = KIND[97:123] = LETTER
KIND[list(K.SPACES)] = SPACE
KIND[[ord("'"), ord("<")]] = ODD  # contractions, names of special tokens
KIND[0xC3] = LETTER  # first byte of the letters from U+00C0 to U+00FF

_tokenizers: dict[str, WordIds] = {}


class WordIds:
    """Ids of words by a tokenizer file, remembered for up to CACHED_WORDS words (which changes the speed only)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}  # word hash to number
        self.ids, self.n_ids = np.zeros(1 << 20, np.uint32), 0
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def learn(self, names: list[int], words: list[str]) -> None:
        for lo in range(0, len(words), 20_000):
            part = names[lo:lo + 20_000]
            found = self.tokenizer.encode_batch_fast(words[lo:lo + 20_000], add_special_tokens=False)
            lists = [f.ids for f in found]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter((i for x in lists for i in x), np.uint32, int(sizes.sum()))
            first, count = len(self.place), len(part)
            while self.n_ids + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while first + count > len(self.start):
                self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
            self.ids[self.n_ids:self.n_ids + len(flat)] = flat
            self.start[first:first + count] = self.n_ids + np.concatenate([[0], np.cumsum(sizes)[:-1]])
            self.size[first:first + count] = sizes
            self.n_ids += len(flat)
            self.place.update(zip(part, range(first, first + count), strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of a run of texts."""
        data, starts, ends, bounds = units(data, offsets)
        word = K.span_hash(K.prefix_sums(K.byte_values(data)), starts, ends) + (ends - starts).astype(np.uint64)
        names, first, number = distinct(word)
        if len(self.place) > CACHED_WORDS:
            self.clear()
        listed = names.tolist()
        new = [i for i, name in enumerate(listed) if name not in self.place]
        if new:
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            self.learn([listed[i] for i in new], [data[a:b].tobytes().decode() for a, b in spans])
        at = np.fromiter(map(self.place.__getitem__, listed), np.int64, len(listed))[number]
        sizes = self.size[at]
        flat = self.ids[K.ranges(self.start[at], sizes)]
        return np.split(flat, np.concatenate([[0], np.cumsum(sizes)])[bounds[1:-1]])


def units(data: np.ndarray, offsets: np.ndarray):
    """Bytes with simple letters in lower case, start and end of every unit, and the number of units before each text.

    Units are runs of simple letters (ASCII, U+00C0 to U+00FF), single digits, and runs of other ASCII signs. A word with any
    other byte is one unit and keeps its case: the tokenizer decides about it as a whole.
    """
    starts, ends, bounds = K.words(data, offsets)
    if not len(starts):
        return data, starts, ends, bounds
    kind, low = KIND[data], K.LOWER[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    value = data[second]
    letter = (value != 0x97) & (value != 0xB7)  # the signs for times and divided by
    kind[second] = np.where(letter, LETTER, ODD)
    low[second] += np.where(letter & (value <= 0x9E), 32, 0).astype(np.uint8)
    odd = np.concatenate([[0], np.cumsum(kind == ODD)])
    whole = odd[ends] > odd[starts]
    inside = K.ranges(starts[whole], (ends - starts)[whole])
    low[inside], kind[inside] = data[inside], ODD
    new = kind != SPACE
    new[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    new[starts] = True  # also where texts touch
    first = np.flatnonzero(new)
    word = np.searchsorted(starts, first, side="right") - 1
    return low, first, np.minimum(np.append(first[1:], len(data)), ends[word]), np.searchsorted(first, offsets)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 64-bit values, the place of one of each, and every value's number among them."""
    bits = max(1, int(len(x)).bit_length())
    low = np.uint64((1 << bits) - 1)
    # the upper bits and the place sort as one number; should they not tell all values apart, sort the values themselves
    order = (np.sort((x & ~low) | np.arange(len(x), dtype=np.uint64)) & low).astype(np.int64)
    value = x[order]
    new = np.ones(len(x), bool)
    new[1:] = value[1:] != value[:-1]
    if (new[1:] & ((value[1:] | low) == (value[:-1] | low))).any():
        order = np.argsort(x, kind="stable")
        value = x[order]
        new[1:] = value[1:] != value[:-1]
    number = np.empty(len(x), np.int64)
    number[order] = np.cumsum(new) - 1
    return value[new], order[new], number


def word_ids(path: str) -> WordIds:
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
          ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
OPEN_FIELDS = [("_group", pa.int64()), ("_ids", pa.binary())]
SCHEMA = pa.schema(FIELDS + OPEN_FIELDS)
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, _group long, _ids binary"


def sequence_number(step: int, group: int, number: int) -> int:
    """Unique over steps (below 64), groups and up to 2^25 sequences of a group."""
    return step << 57 | group << 25 | number


class Packer:
    """Open windows of a task; `rows` gathers the pieces of emitted windows."""

    def __init__(self, length: int, open_windows: int, least_cut: int, step: int, group: int):
        self.length, self.most, self.least_cut, self.step, self.group = length, open_windows, least_cut, step, group
        self.windows: list[tuple[int, list]] = []  # used, pieces
        self.rows, self.number = [], 0

    def emit(self, pieces) -> None:
        name, offset = sequence_number(self.step, self.group, self.number), 0
        self.number += 1
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, name, offset, None, None))
            offset += len(ids)

    def add(self, doc, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.length:
            self.emit([(doc, start, ids[start:start + self.length], total)])
            start += self.length
        while start < total:
            start += self.place(doc, start, ids[start:], total)

    def place(self, doc, start, ids, total) -> int:
        """Ids of the tail that found a window."""
        n = len(ids)
        fitting = [i for i, (used, _) in enumerate(self.windows) if used + n <= self.length]
        if fitting:
            i = max(fitting, key=lambda i: self.windows[i][0])
        elif len(self.windows) < self.most:
            self.windows.append((0, []))
            i = len(self.windows) - 1
        else:
            i = max(range(len(self.windows)), key=lambda i: self.windows[i][0])
            gap = self.length - self.windows[i][0]
            if gap < self.least_cut:
                self.emit(self.windows.pop(i)[1])
                return 0
            n = gap
        used, pieces = self.windows[i]
        pieces.append((doc, start, ids[:n], total))
        self.windows[i] = (used + n, pieces)
        if used + n == self.length:
            self.emit(self.windows.pop(i)[1])
        return n

    def merge(self, last: bool) -> None:
        """Fills the fullest windows from the emptiest; one window stays open unless this is the last round."""
        self.windows.sort(key=lambda w: -w[0])
        left = [(used, list(pieces)) for used, pieces in self.windows]
        self.windows = []
        while left:
            used, pieces = left.pop(0)
            while used < self.length and left:
                under, source = left.pop()
                doc, start, ids, total = source.pop()
                n = min(len(ids), self.length - used)
                pieces.append((doc, start + len(ids) - n, ids[len(ids) - n:], total))
                used += n
                if n < len(ids):
                    source.append((doc, start, ids[:-n], total))
                if under > n:
                    left.append((under - n, source))
            if used == self.length or last:
                self.emit(pieces)
            else:
                self.windows.append((used, pieces))

    def open_rows(self):
        for i, (_, pieces) in enumerate(self.windows):
            for doc, start, ids, total in pieces:
                yield doc, start, len(ids), None, total, i, None, self.group, ids.astype("<u4").tobytes()


def _table(rows) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in SCHEMA]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)


def _pack_pass(batches, path, length, end_id, open_windows, least_cut):
    packer, words = None, word_ids(path)
    for batch in batches:
        ids, parts = batch.column(0).to_pylist(), batch.column(2)
        if packer is None and len(batch):
            packer = Packer(length, open_windows, least_cut, 0, parts[0].as_py())
        for lo, hi, data, offsets in K.chunks(batch.column(1)):
            found = words.encode(data, offsets)
            for i in range(lo, hi):
                packer.add(ids[i], np.append(found[i - lo], np.uint32(end_id)))
            if len(packer.rows) > 10_000:
                yield _table(packer.rows)
                packer.rows = []
    if packer:
        yield _table([*packer.rows, *packer.open_rows()])


def _merge_group(table: pa.Table, length: int, step: int, merge_parts: int, last: bool) -> pa.Table:
    """Open windows of some tasks, in the order of task, window and place."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["_group"], r["sequence_id"], r["doc_id"] or 0, r["start"]))
    group = rows[0]["_group"] // merge_parts
    packer = Packer(length, 0, 0, step, group)
    windows: dict[tuple[int, int], list] = {}
    for r in rows:
        windows.setdefault((r["_group"], r["sequence_id"]), []).append(
            (r["doc_id"], r["start"], np.frombuffer(r["_ids"], "<u4"), r["doc_tokens"]))
    packer.windows = [(sum(len(p[2]) for p in pieces), pieces) for pieces in windows.values()]
    packer.merge(last)
    return pa.Table.from_batches([_table([*packer.rows, *packer.open_rows()])], SCHEMA)


def pack_documents(
    docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, open_windows: int = OPEN_WINDOWS,
    least_cut: int = LEAST_CUT, merge_parts: int = MERGE_PARTS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    `tokenizer`: path of a tokenizer file, the same on every executor.
    """
    spark = docs.sparkSession
    rows = staged(lambda: docs.select("doc_id", "text", F.spark_partition_id().cast("long").alias("_part")).mapInArrow(
        tidy(lambda it: _pack_pass(it, tokenizer, length, end_id, open_windows, least_cut)), DDL), "packed", spark)
    names = [n for n, _ in FIELDS]
    out = rows.where("_group is null").select(names)
    open_ = rows.where("_group is not null")
    most, step = open_.agg(F.max("_group")).first()[0], 0
    while most is not None:
        step, last = step + 1, most < merge_parts

        def merged(open_=open_, step=step, last=last):
            return open_.groupBy(F.floor(F.col("_group") / merge_parts)).applyInArrow(
                tidy(lambda t: _merge_group(t, length, step, merge_parts, last)), DDL)

        rows = staged(merged, "packed-merge", spark)
        out = out.unionByName(rows.where("_group is null").select(names))
        open_, most = rows.where("_group is not null"), None if last else most // merge_parts
    return out
