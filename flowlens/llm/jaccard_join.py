"""Join of documents on the Jaccard similarity of their word shingles by T-occurrence search (DivideSkip).

A document with n shingles and a partner at similarity s share at least T = s * n shingles, so the partner occurs on at
least T of the document's n inverted lists. DivideSkip splits the lists by length: the T - 1 longest are only probed, and every
partner then occurs at least once on the n - T + 1 shortest, which are merged. Steps:

1. Shingles that occur in one document only have lists without partners. They are counted exactly over all documents; a
   document with fewer than T shared shingles is settled (it links with nothing) and its text is not read again.
2. The rest is folded by equal sets; one representative per set goes on, with its shingles ordered by list length.
3. The shortest lists are merged. A list passes on a pair only if enough shingles are left behind it on both sides and
   the sizes fit. Lists up to `short_list` pass on all such pairs.
4. Longer lists (large groups of near copies, common passages) first link their members to one leader per list, the one with
   the fewest rare shingles. After these links are verified, only pairs whose sides are not yet connected are passed on, and
   of these only pairs that can link by their parity sketches: the bits in which two sketches differ are no more than the
   shingles in which the sets differ. So a group is never expanded into all its pairs, and no link between components is lost.
5. Every pair is verified: all shingles of the smaller set are probed by binary search in the larger set.

Links are exact up to collisions of 64-bit hashes. Components are joined with `components`.

Defined results: null, empty and word-free texts have no shingles and link with nothing; fewer than `words_each` words
make one shingle; a doc_id names one document: of differing texts under one doc_id the largest set counts, and each
row gets the document's result; rows without a doc_id link with nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlens.llm import kernels as K
from flowlens.llm.exchange import (
    Collector, components, doc_shard, pack, packed_schema, reply_count, shard_count, shard_of, staged, tidy, unpack)

WORDS_EACH = 5
SHORT_LIST = 2
SKETCH_BITS = 512
FIRST_LISTS = 16  # long lists of a document that travel with each of its entries


def shingle_sets(column: pa.Array, words_each: int):
    """Row and sorted distinct shingle hashes of every text that has words."""
    for lo, hi, data, offsets in K.chunks(column):
        data = K.LOWER[data]
        starts, ends, bounds = K.words(data, offsets)
        sums = K.prefix_sums(K.span_hash(K.prefix_sums(K.byte_values(data)), starts, ends))
        grams = K.rolling_hash(sums, words_each)
        for i in np.flatnonzero(np.diff(bounds)).tolist():
            a, b = int(bounds[i]), int(bounds[i + 1])
            if b - a < words_each:
                whole = K.span_hash(sums, np.array([a]), np.array([b]))
                yield lo + i, K.mix(whole + np.uint64(b - a))
            else:
                x = np.sort(grams[a:b - words_each + 1])
                yield lo + i, x[np.concatenate([[True], x[1:] != x[:-1]])]


def needed(n, percent: int):
    """Smallest number of common shingles of a set of n with any partner."""
    return -(-percent * n // 100)


def _same_as_neighbour(x: np.ndarray) -> np.ndarray:
    some = np.zeros(len(x), bool)
    if len(x) > 1:
        same = x[1:] == x[:-1]
        some[1:] |= same
        some[:-1] |= same
    return some


def _range_shard(token: np.ndarray, shards: int) -> np.ndarray:
    return ((token >> np.uint64(40)).astype(np.int64) * shards) >> 24


def _kind(batch, kind: int):
    return None if batch is None else batch.append_column("kind", pa.array(np.full(len(batch), kind, np.int8)))


INDEX_BITS = 22  # a flush holds fewer entries than 2^22, so a token and its place fit into one sortable number


def _count_pass(batches, shards: int, words_each: int):
    """Tokens of the documents (kind 0), tokens that several documents of the task have (1), set sizes (2), and the number
    of such shared tokens per document (3). A hot token leaves a task once."""
    mask = np.uint64((1 << INDEX_BITS) - 1)

    def emit(token, doc):
        for lo in range(0, len(token), 1 << INDEX_BITS):
            yield from portion(token[lo:lo + (1 << INDEX_BITS)], doc[lo:lo + (1 << INDEX_BITS)])

    def portion(token, doc):
        order = (np.sort((token & ~mask) | np.arange(len(token), dtype=np.uint64)) & mask).astype(np.int64)
        token, doc = token[order], doc[order]
        shared = _same_as_neighbour(token >> np.uint64(INDEX_BITS))
        own = ~shared
        once = shared & np.concatenate([[True], (token[1:] ^ token[:-1]) >> np.uint64(INDEX_BITS) != 0])
        yield _kind(pack(_range_shard(token[own], shards), shards,
                         {"token": (token[own] >> np.uint64(8)).astype(np.uint32), "doc": doc[own]}), 0)
        yield _kind(pack(_range_shard(token[once], shards), shards,
                         {"token": (token[once] >> np.uint64(8)).astype(np.uint32), "doc": doc[once]}), 1)
        docs, counts = np.unique(doc[shared], return_counts=True)
        yield _kind(pack(doc_shard(docs, shards), shards, {"token": counts.astype(np.uint32), "doc": docs}), 3)

    def sizes(n, doc):
        yield _kind(pack(doc_shard(doc, shards), shards, {"token": n.astype(np.uint32), "doc": doc}), 2)

    out, n_out = Collector(emit), Collector(sizes)
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for i, tokens in shingle_sets(batch.column(1), words_each):
            if ids[i] is not None:
                yield from out.add(tokens, np.full(len(tokens), ids[i], np.int64))
                yield from n_out.add(np.array([len(tokens)]), np.array([ids[i]], np.int64))
    yield from out.flush()
    yield from n_out.flush()


COUNTS = pa.schema([("shard", pa.int32()), ("doc", pa.binary()), ("n", pa.binary()), ("kind", pa.int8())])


def _by_kind(table: pa.Table, kind: int) -> pa.Table:
    return table.filter(pa.array([k == kind for k in table["kind"].to_pylist()], pa.bool_()))


def _count_shard(table: pa.Table, replies: int) -> pa.Table:
    """Per document the number of its tokens in this shard that another document has too; sizes pass through."""
    own = _by_kind(table, 0)
    token, doc = unpack(own["token"], np.uint32), unpack(own["doc"], np.int64)
    several = unpack(_by_kind(table, 1)["token"], np.uint32)
    every = np.concatenate([token, several]).astype(np.uint64)
    order = np.sort((every << np.uint64(32)) | np.arange(len(every), dtype=np.uint64))
    at = (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = at[_same_as_neighbour(order >> np.uint64(32))]
    docs, counts = np.unique(doc[at[at < len(token)]], return_counts=True)
    out = [_kind(pack(doc_shard(docs, replies), replies, {"doc": docs, "n": counts.astype(np.uint32)}), 3)]
    for kind in (2, 3):
        part = _by_kind(table, kind)
        docs, n = unpack(part["doc"], np.int64), unpack(part["token"], np.uint32)
        out.append(_kind(pack(doc_shard(docs, replies), replies, {"doc": docs, "n": n}), kind))
    return pa.Table.from_batches([b for b in out if b is not None], COUNTS)


def _count_documents(table: pa.Table) -> pa.Table:
    sizes, shared = _by_kind(table, 2), _by_kind(table, 3)
    doc, n = unpack(sizes["doc"], np.int64), unpack(sizes["n"], np.uint32).astype(np.int64)
    ids, inverse = np.unique(doc, return_inverse=True)
    most = np.zeros(len(ids), np.int64)
    np.maximum.at(most, inverse, n)
    doc, n = unpack(shared["doc"], np.int64), unpack(shared["n"], np.uint32).astype(np.int64)
    total = np.bincount(np.searchsorted(ids, doc), weights=n, minlength=len(ids)).astype(np.int64)
    return pa.table({"_id": ids, "n_shingles": most, "shared": total})


def _set_pass(batches, words_each: int):
    """doc_id, size, two sums that name the set, and the sorted tokens."""
    names = ["doc_id", "n", "s1", "s2", "tokens"]
    for batch in batches:
        ids = batch.column(0).to_pylist()
        rows = [(ids[i], len(t), K.mix(t).sum().astype(np.int64), K.mix(t ^ np.uint64(0xABCDEF)).sum().astype(np.int64),
                 t.tobytes()) for i, t in shingle_sets(batch.column(1), words_each)]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _list_pass(batches, shards: int):
    """Tokens of the representatives with document and set size, to the shard of the token."""
    def emit(key, doc, n):
        yield pack(_range_shard(key, shards), shards, {"key": key, "doc": doc, "n": n})

    out = Collector(emit)
    for batch in batches:
        for doc, n, tokens in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "tokens")), strict=True):
            key = np.frombuffer(tokens, np.uint64)
            yield from out.add(key, np.full(n, doc, np.int64), np.full(n, n, np.uint32))
    yield from out.flush()


def _lengths(table: pa.Table, replies: int) -> pa.Table:
    """Lists of two or more, sent back to the documents with their length."""
    key, doc, n = unpack(table["key"], np.uint64), unpack(table["doc"], np.int64), unpack(table["n"], np.uint32)
    order = np.argsort(key, kind="stable")
    key, doc, n = key[order], doc[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    length = np.repeat(np.diff(np.append(first, len(key))), np.diff(np.append(first, len(key))))
    some = length > 1
    batch = pack(doc_shard(doc[some], replies), replies, {
        "key": key[some], "doc": doc[some], "n": n[some], "length": length[some].astype(np.uint32)})
    schema = pa.schema([("shard", pa.int32()), *[(c, pa.binary()) for c in ("key", "doc", "n", "length")]])
    return pa.Table.from_batches([batch] if batch is not None else [], schema)


def _shortest(table: pa.Table, shards: int, percent: int) -> pa.Table:
    """Each document's n - T + 1 shortest lists, to the shard of the token: document, size, place, and whether it is among the
    document's first three."""
    key, doc, n = unpack(table["key"], np.uint64), unpack(table["doc"], np.int64), unpack(table["n"], np.uint32).astype(np.int64)
    length = unpack(table["length"], np.uint32)
    order = np.lexsort((key, length, doc))
    key, doc, n = key[order], doc[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    many = np.diff(np.append(first, len(doc)))
    nth = np.arange(len(doc)) - np.repeat(first, many)
    place = n - np.repeat(many, many) + nth  # lists of one document stand in front
    merged = place <= n - needed(n, percent)
    key, doc, n, place, nth = (c[merged] for c in (key, doc, n, place, nth))
    batch = pack(_range_shard(key, shards), shards, {
        "key": key, "doc": doc, "n": n.astype(np.uint32), "place": place.astype(np.uint32), "early": (nth < 3).astype(np.uint8)})
    schema = pa.schema([("shard", pa.int32()), *[(c, pa.binary()) for c in ("key", "doc", "n", "place", "early")]])
    return pa.Table.from_batches([batch] if batch is not None else [], schema)


def _possible(n1, left1, n2, left2, percent: int):
    """Whether two sets of these sizes with so many shingles left behind a common one can link."""
    both = (100 + percent) * np.minimum(left1, left2) >= percent * (n1 + n2)
    return both & (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2))


PAIRS = "kind byte, key long, a long, b long, n int, place int"
PAIR_SCHEMA = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32()),
                         ("place", pa.int32())])


def _merge_lists(table: pa.Table, percent: int, short_list: int) -> pa.Table:
    """Pairs from the merged lists (kind 0) and the entries of long lists (kind 1)."""
    key, doc = unpack(table["key"], np.uint64), unpack(table["doc"], np.int64)
    n, place = (unpack(table[c], np.uint32).astype(np.int64) for c in ("n", "place"))
    early = unpack(table["early"], np.uint8).astype(bool)
    order = np.lexsort((K.mix(doc.view(np.uint64)), place, key))  # the leader stands first
    key, doc, n, place, early = (c[order] for c in (key, doc, n, place, early))
    left = n - place
    if not len(key):
        return pa.Table.from_batches([], PAIR_SCHEMA)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    many = np.diff(np.append(first, len(key)))
    size, head = np.repeat(many, many), np.repeat(first, many)
    found = []
    short = size <= short_list
    for gap in range(1, short_list):
        a = np.flatnonzero(short[:-gap] & (key[gap:] == key[:-gap])) if gap < len(key) else np.zeros(0, np.int64)
        if not len(a):
            break
        b = a + gap
        a, b = (x[_possible(n[a], left[a], n[b], left[b], percent)] for x in (a, b))
        found.append((doc[a], doc[b]))
    star = np.flatnonzero(~short & early & (doc != doc[head]))
    found.append((doc[star], doc[head[star]]))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    pairs = pairs[:, pairs[0] != pairs[1]]
    long_ = np.flatnonzero(~short)
    k, m = pairs.shape[1], len(long_)
    zero = np.zeros(k, np.int64)
    return pa.table({
        "kind": np.concatenate([zero, np.ones(m, np.int64)]).astype(np.int8),
        "key": np.concatenate([zero, key[long_].view(np.int64)]), "a": np.concatenate([pairs[0], doc[long_]]),
        "b": np.concatenate([pairs[1], np.zeros(m, np.int64)]), "n": np.concatenate([zero, n[long_]]).astype(np.int32),
        "place": np.concatenate([zero, place[long_]]).astype(np.int32)}, PAIR_SCHEMA)


def _sketches(batches):
    """512 bits per set: whether an even or odd number of its tokens falls on the bit."""
    for batch in batches:
        made = []
        for tokens in batch.column("tokens").to_pylist():
            bit = (K.mix(np.frombuffer(tokens, np.uint64)) >> np.uint64(40)).astype(np.int64) % SKETCH_BITS
            made.append(np.packbits(np.bincount(bit, minlength=SKETCH_BITS) & 1).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.binary())], ["_id", "sketch"])


def _first_lists(column, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and places of the first lists of each row, `m` columns; a missing one has no place (-1)."""
    keys, places = np.zeros((len(column), m), np.int64), np.full((len(column), m), -1, np.int64)
    at = 0
    for chunk in column.chunks:
        many = np.diff(chunk.offsets.to_numpy())
        row = np.repeat(np.arange(at, at + len(chunk)), many)
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        flat = chunk.flatten()
        keys[row, nth], places[row, nth] = flat.field("key").to_numpy(), flat.field("place").to_numpy()
        at += len(chunk)
    return keys, places


def _across(table: pa.Table, percent: int) -> pa.Table:
    """Pairs of long lists whose sides are in different components so far and whose sketches do not rule a link out.

    A pair is left out of a list if its sides share an earlier one, where the bound on what is left is the tighter, among the
    first long lists of both; a pair that shares none of these may come from several lists.
    """
    key, doc, part, n, place = (table[c].to_numpy() for c in ("key", "a", "component", "n", "place"))
    sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(len(doc), -1)
    n, left = n.astype(np.int64), n.astype(np.int64) - place
    first, first_place = _first_lists(table["lists"], FIRST_LISTS)
    order = np.argsort(key, kind="stable")
    found = [np.zeros((2, 0), np.int64)]
    edges = np.flatnonzero(np.diff(key[order])) + 1

    def met_before(one: int, other: np.ndarray) -> np.ndarray:
        earlier = first[one][(first_place[one] >= 0) & (first_place[one] < place[one])]
        return (np.isin(first[other], earlier) & (first_place[other] >= 0)).any(axis=1)

    for group in np.split(order, edges) if len(order) else []:
        parts, inverse, many = np.unique(part[group], return_inverse=True, return_counts=True)
        if len(parts) == 1:
            continue
        outer = inverse != np.argmax(many)  # every pair has a side outside the largest component
        for i in np.flatnonzero(outer):
            one = int(group[i])
            # of two sides that are both outside, the later meets the earlier
            other = group[(inverse != inverse[i]) & (~outer | (np.arange(len(group)) < i))]
            other = other[_possible(n[one], left[one], n[other], left[other], percent)]
            differ = np.bitwise_count(sketch[other] ^ sketch[one]).sum(axis=1, dtype=np.int64)
            other = other[(100 + percent) * differ <= (100 - percent) * (n[one] + n[other])]
            other = doc[other[~met_before(one, other)]]
            found.append(np.stack([np.minimum(doc[one], other), np.maximum(doc[one], other)]))
    pairs = np.unique(np.concatenate(found, axis=1), axis=1)
    return pa.table({"a": pairs[0], "b": pairs[1]})


def long_entries(merged: DataFrame, near: DataFrame, sketches: DataFrame) -> DataFrame:
    """Entries of long lists with component, sketch and first lists of their document: a bounded row each."""
    entries = merged.where("kind = 1").select("key", "a", "n", "place")
    lists = F.slice(F.sort_array(F.collect_list(F.struct("place", "key"))), 1, FIRST_LISTS)
    known = entries.groupBy("a").agg(lists.alias("lists")).join(near, "a", "left").join(sketches, F.col("a") == F.col("_id"))
    return entries.join(known, "a").select(
        "key", "a", "n", "place", F.coalesce("component", "a").alias("component"), "sketch", "lists")


def _probe(batches, percent: int):
    """The pairs that link, by binary search of one set's tokens in the other."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(x) > len(y):
                x, y = y, x
            common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    right = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tb"))
    left = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("ta"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(
        tidy(lambda it: _probe(it, percent)), "a long, b long")


def join_components(docs: DataFrame, percent: int = 80, words_each: int = WORDS_EACH, short_list: int = SHORT_LIST) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) for every row of `docs`."""
    spark = docs.sparkSession
    shards, replies = shard_count(spark), reply_count(spark)
    texts = docs.select("doc_id", "text")

    def counted():
        tokens = texts.mapInArrow(tidy(lambda it: _count_pass(it, shards, words_each)), packed_schema("token", "doc") + ", kind byte")
        shared = tokens.groupBy("shard").applyInArrow(
            tidy(lambda t: _count_shard(t, replies)), "shard int, doc binary, n binary, kind byte")
        return shared.groupBy("shard").applyInArrow(tidy(_count_documents), "_id long, n_shingles long, shared long")

    counts = staged(counted, "shingle-counts", spark)
    open_ = counts.where(F.col("shared") * 100 >= F.col("n_shingles") * percent).select("_id")
    sets = staged(lambda: texts.join(open_.hint("merge"), F.col("doc_id") == F.col("_id")).select("doc_id", "text").mapInArrow(
        tidy(lambda it: _set_pass(it, words_each)), "doc_id long, n long, s1 long, s2 long, tokens binary"), "shingle-sets", spark)

    def members():
        names = sets.select("doc_id", "n", "s1", "s2").distinct()
        alike = names.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
        return names.join(alike, ["n", "s1", "s2"]).groupBy("doc_id").agg(F.max(F.struct("n", "rep")).alias("m")).select(
            "doc_id", F.col("m.rep").alias("rep"))

    member = staged(members, "shingle-members", spark)
    reps = staged(lambda: sets.join(member.where("doc_id = rep").select("doc_id").hint("merge"), "doc_id").groupBy("doc_id").agg(
        F.max(F.struct("n", "tokens")).alias("m")).select("doc_id", "m.n", "m.tokens"), "shingle-representatives", spark)

    def merge():
        lists = reps.mapInArrow(tidy(lambda it: _list_pass(it, shards)), packed_schema("key", "doc", "n"))
        lists = lists.groupBy("shard").applyInArrow(tidy(lambda t: _lengths(t, replies)), packed_schema("key", "doc", "n", "length"))
        lists = lists.groupBy("shard").applyInArrow(
            tidy(lambda t: _shortest(t, shards, percent)), packed_schema("key", "doc", "n", "place", "early"))
        return lists.groupBy("shard").applyInArrow(tidy(lambda t: _merge_lists(t, percent, short_list)), PAIRS)

    merged = staged(merge, "shingle-lists", spark)
    links = staged(lambda: _verified(merged.where("kind = 0").select("a", "b").distinct(), reps, percent), "shingle-links", spark)

    def crossing():
        near = components(links).withColumnRenamed("node", "a")
        sketches = reps.select("doc_id", "tokens").mapInArrow(tidy(_sketches), "_id long, sketch binary")
        across = long_entries(merged, near, sketches).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy(
            "shard").applyInArrow(tidy(lambda t: _across(t, percent)), "a long, b long")
        return _verified(across.distinct(), reps, percent)

    links = links.unionByName(staged(crossing, "shingle-crossing", spark))
    root = components(links).withColumnRenamed("node", "rep")
    root = member.join(root, "rep", "left").select(
        F.col("doc_id").alias("_doc"), F.coalesce("component", "rep").alias("component_id"))
    return docs.select("doc_id").join(counts.select("_id", "n_shingles"), F.col("doc_id") == F.col("_id"), "left").join(
        root, F.col("doc_id") == F.col("_doc"), "left").select(
        "doc_id", F.coalesce("n_shingles", F.lit(0)).alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` whose document is the smallest of its component; rows without a doc_id stay."""
    found = join_components(docs, **options).where("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(found, F.col("doc_id") == F.col("_id"), "left_anti")
