"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Only vectors with the same label (and length) are compared. Equal vectors are folded into one weighted vector first. The
vectors of a label are spread over shards of about `capacity`; each shard gets a graph of several layers, the upper ones ever
sparser. Every vector queries every shard of its label: from the top layer a beam descends to the nearest nodes of the lowest.
A query whose whole beam links searches again with wider beams and at last meets the whole shard, so a large group of near copies is found whole.
Then a sample of the queries is audited against brute force; if one link is missing, all queries of the group search again with a
wider beam, at last the whole shard. Every link found is verified by its cosine in double precision.

A task reports, per vector, the number of its links and the smallest vector it is connected to inside the task, so groups
are never expanded into pairs; `components` joins these reports over shards and tasks. Groups of queries are bounded too
(`query_group`), so a label that holds a third of all rows is many tasks.

Defined results: a vector that is null, empty, zero, or holds null or non-finite values, or whose label is null, links with
nothing; rows that repeat a vec_id with the same vector count as vectors of their own; without a vec_id a row links with nothing and
has no component; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.exchange import components, staged
from flowlens.llm.kernels import mix

LINKS = 16  # of a node in the upper layers; twice as many in the lowest
STEPS = 12  # a beam is expanded in about so many steps
WIDEST = 256  # beam beyond which a query meets the whole shard
BLOCK = 1024  # queries that search together


def diverse(points: np.ndarray, own: np.ndarray, cand: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (nearest first, -1: none) up to `most`: those nearer to the node than to any neighbour taken
    before, then the nearest of the rest."""
    out = np.full((len(own), most), -1, np.int32)
    for lo in range(0, len(own), 256):
        c = cand[lo:lo + 256]
        real = c >= 0
        vectors = points[np.maximum(c, 0)]
        near = np.einsum("qcd,qd->qc", vectors, points[own[lo:lo + 256]])
        among = vectors @ vectors.transpose(0, 2, 1)
        taken = np.zeros(c.shape, bool)
        for j in range(c.shape[1]):
            rival = np.where(taken, among[:, j], -2).max(axis=1)
            taken[:, j] = real[:, j] & (near[:, j] > rival) & (taken.sum(axis=1) < most)
        order = np.argsort(np.where(real, np.where(taken, 0, 1), 2), axis=1, kind="stable")[:, :most]
        rows = np.take_along_axis(c, order, axis=1)
        out[lo:lo + 256, :rows.shape[1]] = rows
    return out


def beam(points: np.ndarray, nexts: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int):
    """The `width` nearest nodes found by each query from its entry nodes: node (-1: none) and cosine, nearest first."""
    q, n = len(queries), len(points)
    rows = np.arange(q)[:, None]
    seen = np.zeros((q, n), bool)
    pad = max(width, entry.shape[1])
    node = np.full((q, pad), -1, np.int32)
    node[:, :entry.shape[1]] = entry
    real = node >= 0
    seen[np.broadcast_to(rows, node.shape)[real], node[real]] = True
    near = np.where(real, np.einsum("qed,qd->qe", points[np.maximum(node, 0)], queries), -np.inf)
    done = ~real
    active, each = np.arange(q), max(4, pad // STEPS)
    while len(active):
        open_ = np.where(done[active], -np.inf, near[active])
        pick = np.argpartition(-open_, each - 1, axis=1)[:, :each] if pad > each else np.argsort(-open_, axis=1)
        usable = np.take_along_axis(open_, pick, axis=1) > -np.inf
        some = usable.any(axis=1)
        active, pick, usable = active[some], pick[some], usable[some]
        if not len(active):
            break
        at = active[:, None]
        done[at, pick] = True
        from_ = np.where(usable, node[at, pick], -1)
        new = np.where(from_[:, :, None] >= 0, nexts[np.maximum(from_, 0)], -1).reshape(len(active), -1)
        new = np.sort(new, axis=1)  # a node may be a neighbour of several
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        fresh = (new >= 0) & ~seen[at, np.maximum(new, 0)]
        r, c = np.nonzero(fresh)
        seen[active[r], new[r, c]] = True
        value = np.full(new.shape, -np.inf, near.dtype)
        value[r, c] = np.einsum("nd,nd->n", points[new[r, c]], queries[active[r]])
        all_near = np.concatenate([near[active], value], axis=1)
        all_node = np.concatenate([node[active], np.where(fresh, new, -1)], axis=1)
        all_done = np.concatenate([done[active], ~fresh], axis=1)
        top = np.argpartition(-all_near, pad - 1, axis=1)[:, :pad]
        near[active] = np.take_along_axis(all_near, top, axis=1)
        node[active] = np.take_along_axis(all_node, top, axis=1)
        done[active] = np.take_along_axis(all_done, top, axis=1)
    order = np.argsort(-near, axis=1, kind="stable")[:, :width]
    return np.take_along_axis(node, order, axis=1), np.take_along_axis(near, order, axis=1)


class Graph:
    """A hierarchical navigable small-world graph over unit vectors; nodes enter in batches that double."""

    def __init__(self, points: np.ndarray, names: np.ndarray, width: int = 64):
        self.points = points.astype(np.float32)
        n = len(points)
        luck = ((mix(names.view(np.uint64)) >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)
        order = np.argsort(mix(names.view(np.uint64) + np.uint64(77)), kind="stable")
        level = np.floor(-np.log(luck) / np.log(LINKS)).astype(int)
        top = int(level.max()) if n else 0
        self.layers = [np.full((n, 2 * LINKS if k == 0 else LINKS), -1, np.int32) for k in range(top + 1)]
        self.members = [order[level[order] >= k] for k in range(top + 1)]
        self.inside = [0] * (top + 1)
        lo = 0
        while lo < n:  # the first batch, and half of any other, meet what is there
            hi = min(n, max(64, 2 * lo), lo + BLOCK)
            batch = order[lo:hi]
            for k in range(top + 1):  # lowest first: a search must not start at a node that is not linked below
                part = batch[level[batch] >= k]
                if len(part):
                    self.insert(k, part, width)
            lo = hi

    def descend(self, queries: np.ndarray, to: int) -> np.ndarray:
        """Entry nodes for layer `to`: from the first node of the top layer that has one, down by a narrow beam."""
        entry = None
        for k in range(len(self.layers) - 1, to - 1, -1):
            if not self.inside[k]:
                continue
            if entry is None:
                entry = np.repeat(self.members[k][:1].astype(np.int32)[None, :], len(queries), axis=0)
            if k > to:
                entry, _ = beam(self.points, self.layers[k], queries, entry, 4)
        return entry

    def insert(self, k: int, part: np.ndarray, width: int) -> None:
        vectors, nexts = self.points[part], self.layers[k]
        cand, near = [], []
        if self.inside[k]:
            for lo in range(0, len(part), BLOCK):
                c, s = beam(self.points, nexts, vectors[lo:lo + BLOCK], self.descend(vectors[lo:lo + BLOCK], k), width)
                cand.append(c)
                near.append(s)
            cand, near = [np.concatenate(cand)], [np.concatenate(near)]
        among = vectors @ vectors.T
        np.fill_diagonal(among, -np.inf)
        peers = np.argsort(-among, axis=1)[:, :width]
        cand.append(np.where(np.take_along_axis(among, peers, axis=1) > -np.inf, part[peers], -1))
        near.append(np.take_along_axis(among, peers, axis=1))
        cand, near = np.concatenate(cand, axis=1), np.concatenate(near, axis=1)
        cand = np.take_along_axis(cand, np.argsort(-near, axis=1)[:, :width], axis=1)
        most = nexts.shape[1]
        nexts[part] = diverse(self.points, part, cand, most)
        self.inside[k] += len(part)
        # links back: each neighbour chooses among its old links and the new nodes
        to, from_ = nexts[part].ravel(), np.repeat(part, most)
        to, from_ = to[to >= 0], from_[nexts[part].ravel() >= 0]
        order = np.argsort(to, kind="stable")
        to, from_ = to[order], from_[order]
        heads, first, many = np.unique(to, return_index=True, return_counts=True)
        new = np.full((len(heads), int(many.max()) if len(heads) else 0), -1, np.int64)
        new[np.repeat(np.arange(len(heads)), many), np.arange(len(to)) - np.repeat(first, many)] = from_
        both = np.concatenate([nexts[heads], new], axis=1)
        both = np.sort(both, axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        for lo in range(0, len(heads), BLOCK):
            b, h = both[lo:lo + BLOCK], heads[lo:lo + BLOCK]
            s = np.where(b >= 0, np.einsum("qcd,qd->qc", self.points[np.maximum(b, 0)], self.points[h]), -np.inf)
            keep = np.argsort(-s, axis=1)[:, :2 * width]
            nexts[h] = diverse(self.points, h, np.take_along_axis(b, keep, axis=1), most)

    def near(self, queries: np.ndarray, least: float, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) with a cosine of about `least` or more, as far as beams of `width` find them."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for lo in range(0, len(queries), BLOCK):
            rows, w = np.arange(lo, min(lo + BLOCK, len(queries))), min(width, len(self.points))
            while len(rows) and w <= max(width, WIDEST):
                node, near = beam(self.points, self.layers[0], queries[rows], self.descend(queries[rows], 0), w)
                hit = (near >= least) & (node >= 0)
                full = hit.all(axis=1) & (w < len(self.points))  # there may be more than the beam holds
                r, c = np.nonzero(hit & ~full[:, None])
                out.append((rows[r], node[r, c].astype(np.int64)))
                rows, w = rows[full], min(4 * w, len(self.points)) if w < len(self.points) else w + 1
            if len(rows):  # a beam as wide as the shard
                r, c = np.nonzero(queries[rows] @ self.points.T >= least)
                out.append((rows[r], c))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    top = np.abs(vectors).max(axis=1, keepdims=True)
    vectors = vectors / top
    return vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table[column].chunks])
    return flat.reshape(len(table), -1)


def _build(key, table: pa.Table) -> pa.Table:
    label, dim, shard = (k.as_py() for k in key)
    names, weight = table["rep"].to_numpy(), table["weight"].to_numpy()
    order = np.argsort(names, kind="stable")
    vectors = unit_rows(_matrix(table, "embedding"))[order]
    graph = Graph(vectors, names[order])
    blob = pickle.dumps((names[order], weight[order], vectors, graph))
    return pa.table({"label": pa.array([label], pa.int32()), "dim": pa.array([dim], pa.int32()),
                     "shard": pa.array([shard], pa.int64()), "graph": pa.array([blob], pa.binary())})


def linked(names, weight, vectors, graph: Graph, ids, queries, least: float, width: int, audits: int):
    """Verified links of the queries (query, node) without a vector's link to itself, and the beam that passed the audit."""
    slack = least - 1e-4
    sample = np.argsort(mix(ids.view(np.uint64) + np.uint64(5)), kind="stable")[:audits]
    truth = np.argwhere(queries[sample] @ vectors.T >= least)
    truth = truth[ids[sample[truth[:, 0]]] != names[truth[:, 1]]]
    while True:
        row, node = graph.near(queries.astype(np.float32), slack, width)
        cos = np.einsum("nd,nd->n", queries[row], vectors[node])
        row, node = row[cos >= least], node[cos >= least]
        found = np.sort(row * len(vectors) + node)
        wanted = sample[truth[:, 0]] * len(vectors) + truth[:, 1]
        at = np.minimum(np.searchsorted(found, wanted), max(len(found) - 1, 0))
        if not len(wanted) or (len(found) and (found[at] == wanted).all()) or width >= len(vectors):
            break
        width *= 2
    other = ids[row] != names[node]
    return row[other], node[other], width


def smallest_connected(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest number reachable from each of n numbers over the edges (a, b)."""
    root = np.arange(n)
    while True:
        new = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


REPORT = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _query(graphs: pa.Table, questions: pa.Table, least: float, width: int, audits: int) -> pa.Table:
    """Per query the weight of its links in the shard and the smallest vector it is connected to in this task."""
    if not len(graphs) or not len(questions):
        return pa.Table.from_batches([], REPORT)
    names, weight, vectors, graph = pickle.loads(graphs["graph"][0].as_py())
    ids = questions["rep"].to_numpy()
    row, node, _ = linked(names, weight, vectors, graph, ids, unit_rows(_matrix(questions, "embedding")), least, width, audits)
    links = np.bincount(row, weights=weight[node], minlength=len(ids)).astype(np.int64)
    known = np.unique(np.concatenate([ids[row], names[node]]))
    root = known[smallest_connected(np.searchsorted(known, ids[row]), np.searchsorted(known, names[node]), len(known))]
    some = np.flatnonzero(links)
    return pa.table({"rep": np.concatenate([ids[some], known]), "links": np.concatenate([links[some], np.zeros(len(known), np.int64)]),
                     "root": np.concatenate([ids[some], root])}, REPORT)


def usable(vector: Column) -> Column:
    """Not null or empty, all values finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def link_vectors(vectors: DataFrame, least: float = 0.98, capacity: int = 16_384, query_group: int = 4096, width: int = 64,
                 audits: int = 64) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of `vectors` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding", F.col("label").cast("int").alias("label")).withColumn(
        "ok", usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    named = rows.where("ok").withColumn("dim", F.size("embedding")).withColumn(
        "h1", F.xxhash64("embedding")).withColumn("h2", F.hash("embedding"))
    key = ["label", "dim", "h1", "h2"]

    def folded():
        one = named.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"),
                                      F.min("embedding").alias("embedding"))
        return one.join(one.groupBy("label", "dim").agg(F.count("*").alias("many")), ["label", "dim"]).select(
            *key, "rep", "weight", "embedding", F.pmod(F.xxhash64("rep"), F.ceil(F.col("many") / capacity)).alias("shard"),
            F.ceil(F.col("many") / capacity).alias("shards"), F.ceil(F.col("many") / query_group).alias("groups"))

    reps = staged(folded, "link-vectors", spark)
    graphs = staged(lambda: reps.select("label", "dim", "shard", "rep", "weight", "embedding").groupBy(
        "label", "dim", "shard").applyInArrow(lambda k, t: _build(k, t), "label int, dim int, shard long, graph binary"), "link-graphs", spark)

    def asked():
        place = ["label", "dim", "shard", "part"]
        # a label's number of query groups is the same in all of its rows
        groups = reps.groupBy("label", "dim", "shard").agg(F.max("groups").alias("groups"))
        left = graphs.join(groups, ["label", "dim", "shard"]).withColumn(
            "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).select(*place, "graph")
        right = reps.select("label", "dim", "rep", "embedding", F.pmod(F.xxhash64("rep", F.lit(1)), "groups").alias("part"),
                            F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
        return left.groupBy(*place).cogroup(right.groupBy(*place)).applyInArrow(
            lambda a, b: _query(a, b, least, width, audits), "rep long, links long, root long")

    reports = staged(asked, "link-reports", spark)
    near = components(reports.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = reports.groupBy("rep").agg(F.sum("links").alias("links"))
    found = reps.select(*key, "rep", "weight").join(counts, "rep", "left").join(
        near.withColumnRenamed("node", "rep"), "rep", "left").select(
        *key, (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"))
    linked_rows = named.join(found, key).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
