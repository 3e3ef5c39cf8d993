"""Removal of long byte strings that an earlier document already has, by a logarithmic family of suffix arrays.

A byte goes if it lies in a string of `length` bytes that also starts in a document with a smaller doc_id.

Sampled suffixes. Every string of `length` bytes belongs to the suffix that starts at its smallest hashed `seed` bytes; equal
strings belong to equal seeds at equal places. Neighbouring strings of one seed form a run, about one in
(length - seed) / 2 bytes, so the suffix arrays hold runs instead of all suffixes.

Index family. Seeds are spread over shards. In a shard, each arriving batch (the runs of one scan task) becomes an array sorted
by seed and run. It is merge-scanned against every level of the shard's family: an equal run means that the later
document repeats it. What is new becomes a level; two levels of equal size class merge, so a family of n batches has log n
levels. Seeds that occur in differing runs mark the ends of matches: only for the first document of each such run are
the single strings compared, in a second pass over the documents concerned, which settles the exact ends.

Defined results: a null text counts as empty; texts shorter than `length` lose nothing; rows with the same doc_id never remove
from each other; rows without a doc_id match nothing; extra columns are kept; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlens.llm import kernels as K
from flowlens.llm.exchange import (
    Collector, doc_shard, give_rest, keep_rest, pack, packed_schema, reply_count, shard_count, shard_of, staged, tidy, unpack)

LENGTH = 50
SEED = 24
MADE = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
TYPES = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())


def seed_runs(data: np.ndarray, offsets: np.ndarray, length: int, seed: int):
    """Runs of strings with one seed: text number, first string, end of the last string, seed hash, run hash; and the sums."""
    sums = K.prefix_sums(K.byte_values(data))
    lowest = K.sliding_min(K.rolling_hash(sums, seed), length - seed + 1)
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    at = K.ranges(offsets[:-1], sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), sums
    key = lowest[at]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    start, end = at[first], at[last] + length
    key = K.mix(key[first])
    run = K.mix(K.span_hash(sums, start, end) ^ (key + (end - start).astype(np.uint64)))
    return text[first], start, end, key, run, sums


def ordered(seed: np.ndarray, low: np.ndarray, doc: np.ndarray):
    """Sorted by seed and run hash. `seed` holds 32 bits of the seed and 32 of the run, `low` the other 32 of the run."""
    order = np.argsort(seed, kind="stable")
    a, b = seed[order], low[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((low, seed))
        a, b = seed[order], low[order]
    return a, b, doc[order]


def first_of_runs(seed: np.ndarray, low: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], (seed[1:] != seed[:-1]) | (low[1:] != low[:-1])])


def run_hash(seed: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (seed << np.uint64(32)) | low.astype(np.uint64)


class Levels:
    """The index family of one shard: sorted arrays of (seed, low, doc), at most one of each size class."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.later: list[tuple[np.ndarray, np.ndarray]] = []  # (document, run) that repeats an earlier document's

    def merged(self, *parts):
        """One sorted array; of equal runs the smallest document stays and the others are noted as repeats."""
        seed, low, doc = ordered(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        first = np.flatnonzero(first_of_runs(seed, low))
        if len(first) == len(seed):
            return seed, low, doc
        least = np.minimum.reduceat(doc, first)
        beaten = doc != np.repeat(least, np.diff(np.append(first, len(doc))))
        self.later.append((doc[beaten], run_hash(seed[beaten], low[beaten])))
        return seed[first], low[first], least

    def add(self, seed, low, doc) -> None:
        if not len(seed):
            return
        batch = self.merged((seed, low, doc))
        for level in self.levels:  # merge-scan: runs that the level has leave the batch
            at = np.minimum(np.searchsorted(level[0], batch[0]), len(level[0]) - 1)
            hit = (level[0][at] == batch[0]) & (level[1][at] == batch[1])
            if hit.any():
                here, there = batch[2][hit], level[2][at[hit]]
                level[2][at[hit]] = np.minimum(here, there)
                differ = here != there
                self.later.append((np.maximum(here, there)[differ], run_hash(batch[0][hit], batch[1][hit])[differ]))
                batch = tuple(c[~hit] for c in batch)
        if len(batch[0]):
            self.levels.append(batch)
        self.levels.sort(key=lambda x: -len(x[0]))
        while len(self.levels) > 1 and len(self.levels[-2][0]).bit_length() <= len(self.levels[-1][0]).bit_length():
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(self.merged(a, b))
            self.levels.sort(key=lambda x: -len(x[0]))

    def all(self):
        return self.merged(*self.levels) if self.levels else (np.zeros(0, np.uint64),) * 3


def _sent(shard, shards, answered, **columns):
    batch = pack(shard, shards, columns)
    return None if batch is None else batch.append_column("answered", pa.array(np.full(len(batch), answered, np.int8)))


def _first_pass(batches, shards, length, seed):
    """Runs of the documents. Repeats within the task are answered here, so a hot run leaves a task once."""
    def emit(key, run, doc):
        a, b, doc = ordered((key << np.uint64(32)) | (run >> np.uint64(32)), run.astype(np.uint32), doc)
        first = np.flatnonzero(first_of_runs(a, b))
        sizes = np.diff(np.append(first, len(doc)))
        least = np.minimum.reduceat(doc, first)
        later = doc != np.repeat(least, sizes)
        # the shard must follow from the seed alone
        yield _sent(shard_of(a[first] >> np.uint64(32), shards), shards, 0, seed=a[first], low=b[first], doc=least)
        run = run_hash(a[later], b[later])
        yield _sent(shard_of(run, shards), shards, 1, seed=run, low=b[later], doc=doc[later])

    out = Collector(emit)
    for batch in batches:
        ids = batch.column(0)
        doc_ids, known = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)
        for lo, _, data, offsets in K.chunks(batch.column(1)):
            text, _, _, key, run, _ = seed_runs(data, offsets, length, seed)
            ok = known[lo + text]
            yield from out.add(key[ok], run[ok], doc_ids[lo + text[ok]])
    yield from out.flush()


ANSWER = pa.schema([("shard", pa.int32()), ("doc", pa.binary()), ("run", pa.binary()), ("kind", pa.binary())])


def _answers(docs, runs, kind, replies) -> pa.Table:
    batch = pack(doc_shard(docs, replies), replies, {"doc": docs, "run": runs, "kind": kind})
    return pa.Table.from_batches([batch] if batch is not None else [], ANSWER)


def _match_shard(table: pa.Table, replies: int) -> pa.Table:
    """Answers of one shard, packed by the shard of the document: repeated runs (1) and runs to compare string by string (0)."""
    family = Levels()
    for seed, low, doc, answered in zip(*(table[c].to_pylist() for c in ("seed", "low", "doc", "answered")), strict=True):
        seed, low, doc = np.frombuffer(seed, np.uint64), np.frombuffer(low, np.uint32), np.frombuffer(doc, np.int64)
        if answered:
            family.later.append((doc, seed))
        else:
            family.add(seed, low, doc)
    seed, low, doc = family.all()
    several = np.zeros(len(seed), bool)
    if len(seed) > 1:
        key = seed >> np.uint64(32)
        same = key[1:] == key[:-1]
        several[1:] |= same
        several[:-1] |= same
    docs = np.concatenate([doc[several], *[d for d, _ in family.later]]).astype(np.int64)
    runs = np.concatenate([run_hash(seed[several], low[several]), *[r for _, r in family.later]]).astype(np.uint64)
    kind = np.ones(len(docs), np.int8)
    kind[:int(several.sum())] = 0
    return _answers(docs, runs, kind, replies)


def _per_document(table: pa.Table) -> pa.Table:
    """Packed answers to one row per document: its repeated runs and its runs to compare."""
    docs, runs = unpack(table["doc"], np.int64), unpack(table["run"], np.uint64)
    kind = unpack(table["kind"], np.int8)
    order = np.argsort(docs, kind="stable")
    docs, runs, kind = docs[order], runs[order], kind[order]
    ids, first = np.unique(docs, return_index=True)
    rows = [(r[k == 1].tobytes(), r[k == 0].tobytes())
            for r, k in zip(np.split(runs, first[1:]), np.split(kind, first[1:]), strict=True)] if len(ids) else []
    return pa.table({"_id": pa.array(ids, pa.int64()), "_whole": pa.array([a for a, _ in rows], pa.binary()),
                     "_parts": pa.array([b for _, b in rows], pa.binary())})


def _finish(text: bytes, starts: np.ndarray, ends: np.ndarray, with_text: bool):
    """Text, numbers and digest of what stays when the union of the spans is cut out."""
    starts, ends = K.merge_spans(starts, ends)
    kept, at = [], 0
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        kept.append(text[at:s])
        at = e
    kept.append(text[at:])
    rest = b"".join(kept)
    left = rest.decode("utf-8", "ignore") if with_text else None
    return left, len(text), int((ends - starts).sum()), len(starts), hashlib.sha256(rest).hexdigest()


def _batch(batch, rows, more=()):
    """doc_id and the extra columns of a batch with what was made of each row."""
    types = (*TYPES, *[pa.binary()] * len(more))
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
    made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_rest"), *made], ["doc_id", "_rest", "text", *MADE, *more])


def _second_pass(batches, length, seed, with_text):
    """Joined documents: whole runs become spans; documents with runs to compare stay pending with their string hashes."""
    for batch in batches:
        whole, parts = batch.column("_whole").to_pylist(), batch.column("_parts").to_pylist()
        rows: list[tuple] = [()] * len(batch)
        for lo, hi, data, offsets in K.chunks(batch.column("text")):
            raw = data.tobytes()
            if any(whole[lo:hi]) or any(parts[lo:hi]):
                text, start, end, _, run, _ = seed_runs(data, offsets, length, seed)
                bounds = np.searchsorted(text, np.arange(hi - lo + 1))
            for i in range(lo, hi):
                a, b = int(offsets[i - lo]), int(offsets[i - lo + 1])
                spans, todo = np.zeros((2, 0), np.int64), np.zeros((2, 0), np.int64)
                if whole[i] or parts[i]:
                    s = slice(bounds[i - lo], bounds[i - lo + 1])
                    all_of = np.isin(run[s], np.frombuffer(whole[i], np.uint64))
                    open_ = np.isin(run[s], np.frombuffer(parts[i], np.uint64)) & ~all_of
                    spans = np.stack([start[s][all_of], end[s][all_of]]) - a
                    todo = np.stack([start[s][open_], end[s][open_]]) - a
                if todo.shape[1]:
                    rows[i] = (raw[a:b].decode(), None, None, None, None, spans.tobytes(), todo.tobytes())
                else:
                    rows[i] = (*_finish(raw[a:b], *spans, with_text), None, None)
        yield _batch(batch, rows, ("_spans", "_todo"))


def _strings_of(batch):
    """Places of the strings that a batch of pending documents compares: row, place, hash."""
    for lo, hi, data, offsets in K.chunks(batch.column("text")):
        sums = K.prefix_sums(K.byte_values(data))
        yield lo, hi, data, offsets, sums


def _string_pass(batches, shards, length):
    def emit(key, doc):
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = doc[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        later = doc != first
        yield _sent(shard_of(key[new], shards), shards, 0, key=key[new], doc=doc[new])
        yield _sent(shard_of(key[later], shards), shards, 1, key=key[later], doc=doc[later])

    out = Collector(emit)
    for batch in batches:
        ids, todo = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("_todo").to_pylist()
        for lo, hi, _, offsets, sums in _strings_of(batch):
            for i in range(lo, hi):
                start, end = np.frombuffer(todo[i], np.int64).reshape(2, -1)
                at = K.ranges(start, end - start - length + 1) + offsets[i - lo]
                yield from out.add(K.span_hash(sums, at, at + length), np.full(len(at), ids[i]))
    yield from out.flush()


def _match_strings(table: pa.Table, replies: int) -> pa.Table:
    key, doc = unpack(table["key"], np.uint64), unpack(table["doc"], np.int64)
    counts = np.array([len(k) // 8 for k in table["key"].to_pylist()])
    answered = np.repeat(np.array(table["answered"].to_pylist(), bool), counts)
    order = np.lexsort((doc, key))
    key, doc, answered = key[order], doc[order], answered[order]
    later = answered
    if len(key):
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = doc[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        later = answered | (doc != first)
    return _answers(doc[later], key[later], np.ones(int(later.sum()), np.int8), replies)


def _last_pass(batches, length, with_text):
    for batch in batches:
        spans, todo, found = (batch.column(c).to_pylist() for c in ("_spans", "_todo", "_whole"))
        rows = []
        for lo, hi, data, offsets, sums in _strings_of(batch):
            raw = data.tobytes()
            for i in range(lo, hi):
                a, b = int(offsets[i - lo]), int(offsets[i - lo + 1])
                start, end = np.frombuffer(spans[i], np.int64).reshape(2, -1)
                first, last = np.frombuffer(todo[i], np.int64).reshape(2, -1)
                at = K.ranges(first, last - first - length + 1)
                hit = np.isin(K.span_hash(sums, at + a, at + a + length), np.frombuffer(found[i] or b"", np.uint64))
                at = at[hit]
                rows.append(_finish(raw[a:b], np.concatenate([start, at]), np.concatenate([end, at + length]), with_text))
        yield _batch(batch, rows)


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, with_text: bool = True) -> DataFrame:
    """`docs` with the text that stays, n_bytes, n_removed, n_spans and kept_sha256.

    The text drops what is left of a character that is cut in the middle; the digest is of the remaining bytes. Without
    `with_text` it is null, for those who want the numbers only.
    """
    spark = docs.sparkSession
    shards, replies = shard_count(spark), reply_count(spark)
    answer = "shard int, doc binary, run binary, kind binary"
    per_document = "_id long, _whole binary, _parts binary"
    kept = keep_rest(docs, "doc_id", "text")
    rest = kept.schema["_rest"].dataType.simpleString()
    made = f"doc_id long, _rest {rest}, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def answers():
        runs = docs.select("doc_id", "text").mapInArrow(
            tidy(lambda it: _first_pass(it, shards, length, seed)), packed_schema("seed", "low", "doc") + ", answered byte")
        found = runs.groupBy("shard").applyInArrow(tidy(lambda t: _match_shard(t, replies)), answer)
        return found.groupBy("shard").applyInArrow(tidy(_per_document), per_document)

    answered = staged(answers, "repeat-answers", spark)

    def settled():
        joined = kept.join(answered.hint("merge"), F.col("doc_id") == F.col("_id"), "left").drop("_id")
        return joined.mapInArrow(
            tidy(lambda it: _second_pass(it, length, seed, with_text)), f"{made}, _spans binary, _todo binary")

    half = staged(settled, "repeat-half", spark)
    pending = half.where("_todo is not null")

    def compared():
        strings = pending.select("doc_id", "text", "_todo").mapInArrow(
            tidy(lambda it: _string_pass(it, shards, length)), packed_schema("key", "doc") + ", answered byte")
        found = strings.groupBy("shard").applyInArrow(tidy(lambda t: _match_strings(t, replies)), answer)
        return found.groupBy("shard").applyInArrow(tidy(_per_document), per_document)

    found = staged(compared, "repeat-strings", spark)
    last = pending.select("doc_id", "text", "_rest", "_spans", "_todo").join(found.hint("merge"), F.col("doc_id") == F.col("_id"), "left")
    last = last.mapInArrow(tidy(lambda it: _last_pass(it, length, with_text)), made)
    done = half.where("_todo is null").drop("_spans", "_todo")
    return give_rest(done.unionByName(last), "text", *MADE)
