"""Exact k nearest neighbours by Euclidean distance, as a pruned join of bounded blocks.

1. Equal vectors become one representative that keeps its k + 1 smallest ids.
2. Representatives go to a near one of the pivots, found over a first level of pivots; there is a pivot for every block
   of rows, so cells stay small while the table grows. From each cell's radius and its k + 1 smallest pivot
   distances follows an upper bound on the neighbour distance of every query cell; cells that are farther by
   the triangle inequality are not visited. Tasks compare the cells, a share of the query cells each.
3. Cells are cut into blocks of bounded size, and the blocks of either side are dealt into shares. A task meets one share of
   queries with one share of points, cell by cell as found in 2, and passes on only the k + 1 best per query, never the pairs. A
   row travels once per share of the other side that it must meet, not once per block: there are as many shares as give every
   core work, more only where a share would outgrow `SHARE_BYTES`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowlens.functions.columns import hash_key
from flowlens.operators.ordering import broadcast_if_small
from flowlens.session import cut_lineage, ship_package

BLOCK = 2048
MOST_PIVOTS = 4096
CELLS_A_PART = 64
SHARE_BYTES = 64 << 20
DISTANCES = 4 << 20  # of a task at once
HOT_COPIES = 50_000


def _representatives(rows: DataFrame, groups: Sequence[str], keep: int) -> DataFrame:
    """One row per distinct vector: `_ids` (the smallest, at most `keep`), `_rep`, `_copies`."""
    keys = [*groups, "_vec"]
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy("_id"))
    few = rows.withColumn("_rn", rn).where(F.col("_rn") <= keep)
    ids = few.groupBy(*keys).agg(F.sort_array(F.collect_list("_id")).alias("_ids"))
    return ids.withColumn("_rep", F.col("_ids")[0])


class Pivots:
    """Two levels: a row looks for its nearest pivot among those of the `near` nearest first pivots only."""

    def __init__(self, centres: np.ndarray, near: int = 2):
        self.centres = centres
        self.heads = centres[:math.ceil(math.sqrt(len(centres)))]
        self.near = min(near, len(self.heads))
        home = _squares(centres, self.heads).argmin(axis=1)
        self.members = [np.flatnonzero(home == h) for h in range(len(self.heads))]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row, and the distance to its pivot measured without cancellation."""
        heads = np.argsort(_squares(x, self.heads), axis=1)[:, :self.near]
        best, cell = np.full(len(x), np.inf), np.zeros(len(x), dtype="int64")
        for h, members in enumerate(self.members):
            rows = np.flatnonzero((heads == h).any(axis=1))
            if not len(rows) or not len(members):
                continue
            d = _squares(x[rows], self.centres[members])
            at = d.argmin(axis=1)
            d = d[np.arange(len(rows)), at]
            closer = d < best[rows]
            best[rows[closer]], cell[rows[closer]] = d[closer], members[at[closer]]
        return cell, np.sqrt(((x - self.centres[cell]) ** 2).sum(axis=1))


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2.0 * x @ y.T


def _place(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """The pivot `_cell` and the distance to it `_radius`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cell, radius = pivots.place(np.stack(pdf["_vec"].to_numpy()))
                pdf = pdf.assign(_cell=cell.astype("int32"), _radius=radius)
            else:
                pdf = pdf.assign(_cell=pd.Series(dtype="int32"), _radius=pd.Series(dtype="float64"))
            yield pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{schema}, _cell int, _radius double")


def _cells(rows: DataFrame, groups: Sequence[str], block: int) -> DataFrame:
    """Blocks and largest radius of each cell."""
    return rows.groupBy(*groups, "_cell").agg(
        F.ceil(F.count("*") / block).cast("int").alias("_subs"), F.max("_radius").alias("_most"))


def _visits(points: DataFrame, queries: DataFrame, groups: Sequence[str], pivots: Pivots, need: int, block: int) -> DataFrame:
    """Rows (group..., query cell, its blocks, point cell, its blocks) that must meet."""
    rn = F.row_number().over(Window.partitionBy(*groups, "_cell").orderBy("_radius"))
    closest = points.select(*groups, "_cell", "_radius").withColumn("_rn", rn).where(F.col("_rn") <= need)
    near = closest.groupBy(*groups, "_cell").agg(F.collect_list("_radius").alias("_near"))  # at most `need` numbers
    parts = math.ceil(len(pivots.centres) / CELLS_A_PART)
    p_cells = _cells(points, groups, block).join(near, [*groups, "_cell"]).withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    q_cells = _cells(queries, groups, block).withColumn("_part", F.pmod("_cell", F.lit(parts)))
    q_cells = q_cells.toDF(*[f"q{c}" for c in q_cells.columns])  # names of its own: both sides may come from the same rows
    keys = [*groups, "_part"]
    names = [*groups, "_qcell", "_qsubs", "_pcell", "_psubs"]

    def meet(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({n: [] for n in names})
        p_cell, p_most = p["_cell"].to_numpy(), p["_most"].to_numpy()
        radii = np.full((len(p), need), np.inf)
        for i, values in enumerate(p["_near"]):
            radii[i, :len(values)] = values
        kept = []
        for i, (cell, most) in enumerate(zip(q["q_cell"], q["q_most"], strict=True)):
            gap = np.sqrt(((pivots.centres[p_cell] - pivots.centres[cell]) ** 2).sum(axis=1))
            reach = (gap[:, None] + radii).ravel()
            bound = most + (np.partition(reach, need - 1)[need - 1] if len(reach) >= need else math.inf)
            at = np.flatnonzero(gap - most - p_most <= bound * (1 + 1e-9) + 1e-12)
            kept.append((np.full(len(at), i), at))
        i, at = (np.concatenate(k) for k in zip(*kept, strict=True))
        q_at, p_at = q.iloc[i], p.iloc[at]
        out = {g: p_at[g].to_numpy() for g in groups}
        return pd.DataFrame(out | {"_qcell": q_at["q_cell"].to_numpy(), "_qsubs": q_at["q_subs"].to_numpy(),
                                   "_pcell": p_at["_cell"].to_numpy(), "_psubs": p_at["_subs"].to_numpy()})

    kinds = [f"`{g}` {points.schema[g].dataType.simpleString()}" for g in groups]
    return q_cells.groupBy(*[f"q{k}" for k in keys]).cogroup(p_cells.groupBy(*keys)).applyInPandas(
        meet, ", ".join([*kinds, "_qcell int, _qsubs int, _pcell int, _psubs int"]))


def _shares(asked: int, known: int, dims: int, block: int, cores: int) -> tuple[int, int]:
    """Shares of the queries and of the points: work for all cores, bounded rows per share, as few rows sent as that allows."""
    most = max(block, SHARE_BYTES // (8 * dims + 64))
    tasks = max(1, min(3 * cores, math.ceil(asked * known / block**2)))
    found = []
    for p in range(max(1, math.ceil(known / most)), max(1, math.ceil(known / most)) + tasks):
        q = max(1, math.ceil(asked / most), math.ceil(tasks / p))
        found.append((p * asked + q * known, q, p))
    return min(found)[1:]


def _share(groups: Sequence[str], cell: str | Column, sub: Column, shares: int) -> Column:
    return F.pmod(F.xxhash64(*groups, cell, sub), F.lit(shares)).cast("int")


def _all_shares(groups: Sequence[str], cell: str, subs: str, shares: int) -> Column:
    """The shares that have a block of a cell."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.col(subs) - 1), lambda s: _share(groups, cell, s, shares)))


def _sent(rows: DataFrame, meets: DataFrame, groups: Sequence[str], side: str, own: int, other: int) -> DataFrame:
    """The rows of one side, once per share of the other side that they must meet; `_mine` and `_theirs` are the shares."""
    them = "p" if side == "q" else "q"
    wanted = meets.select(*groups, F.col(f"_{side}cell").alias("_cell"), F.col(f"_{side}subs").alias("_subs"), F.explode(
        _all_shares(groups, f"_{them}cell", f"_{them}subs", other)).alias("_theirs"))
    ways = broadcast_if_small(wanted.groupBy(*groups, "_cell", "_subs").agg(F.collect_set("_theirs").alias("_to")))
    sub = F.pmod(F.xxhash64("_rep"), F.col("_subs")).cast("int")
    return rows.join(ways, [*groups, "_cell"]).select(
        *groups, "_cell", "_rep", "_ids", "_vec", _share(groups, "_cell", sub, own).alias("_mine"), F.explode("_to").alias("_theirs"))


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = vectors.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _ranks(values: pa.Array) -> np.ndarray:
    order = pc.sort_indices(values).to_numpy()
    out = np.empty(len(order), dtype="int64")
    out[order] = np.arange(len(order))
    return out


def _nearest(x: np.ndarray, y: np.ndarray, place: np.ndarray, need: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, point, distance) of the `need` nearest rows of `y`, by distance and `place`, for a part of `x` after the other."""
    yy, k = (y * y).sum(axis=1), min(need, len(y))
    step = max(1, min(256, DISTANCES // len(y)))
    for start in range(0, len(x), step):
        part = x[start:start + step]
        xx = (part * part).sum(axis=1)
        rough = xx[:, None] + yy[None, :] - 2.0 * part @ y.T
        # everything within rounding of the k-th is measured again without cancellation
        limit = np.partition(rough, k - 1, axis=1)[:, k - 1] + 1e-9 * (xx + yy.max())
        i, j = np.nonzero(rough <= limit[:, None])
        exact = np.empty(len(i))
        for at in range(0, len(i), 1 << 16):
            some = slice(at, at + (1 << 16))
            exact[some] = np.sqrt(((y[j[some]] - part[i[some]]) ** 2).sum(axis=1))
        order = np.lexsort((place[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < k
        yield i[best] + start, j[best], exact[best]


def _meet_shares(need: int, groups: Sequence[str], schema: pa.Schema):
    """A share of queries (`_side` 1) and one of points (2), met cell by cell as the visits (0) say: distances and ids per query."""

    def run(table: pa.Table) -> pa.Table:
        side = table["_side"]
        visits, q, p = (table.filter(pc.equal(side, n)) for n in range(3))
        if not len(visits) or not len(q) or not len(p):
            return schema.empty_table()
        x, y = _matrix(q["_vec"]), _matrix(p["_vec"])
        at = {}
        for name, rows in (("q", q), ("p", p)):
            keys = rows["_key"].combine_chunks().dictionary_encode()
            order = np.argsort(keys.indices.to_numpy(), kind="stable")
            ends = np.cumsum(np.bincount(keys.indices.to_numpy(), minlength=len(keys.dictionary)))
            at[name] = dict(zip(keys.dictionary.to_pylist(), np.split(order, ends[:-1]), strict=True))
        lists = p["_ids"].combine_chunks()
        ids, first = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        place, id_place = _ranks(p["_rep"].combine_chunks()), _ranks(ids)
        met: dict[str, list] = {}
        for key, other in zip(visits["_key"].to_pylist(), visits["_other"].to_pylist(), strict=True):
            if key in at["q"] and other in at["p"]:
                met.setdefault(key, []).append(at["p"][other])
        asked, dists, nids = [], [], []
        for key, cells in met.items():
            mine, known = at["q"][key], np.concatenate(cells)
            for i, j, d in _nearest(x[mine], y[known], place[known], need):
                j = known[j]
                sizes = first[j + 1] - first[j]
                i, d, e = np.repeat(i, sizes), np.repeat(d, sizes), np.repeat(first[j] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                order = np.lexsort((id_place[e], d, i))
                i, d, e = i[order], d[order], e[order]
                best = np.arange(len(i)) - np.searchsorted(i, i) < need
                asked.append(mine[i[best]])
                dists.append(d[best])
                nids.append(e[best])
        if not asked:
            return schema.empty_table()
        asked = np.concatenate(asked)
        starts = np.flatnonzero(np.concatenate([[True], np.diff(asked) != 0]))
        offsets = pa.array(np.append(starts, len(asked)), pa.int32())
        rows = q.take(pa.array(asked[starts]))
        out = [rows[g].combine_chunks() for g in (*groups, "_rep")]
        out += [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(dists))),
                pa.ListArray.from_arrays(offsets, ids.take(pa.array(np.concatenate(nids))))]
        return pa.Table.from_arrays(out, names=schema.names).cast(schema)

    return run


def _search(placed: DataFrame, q_placed: DataFrame, meets: DataFrame, groups: Sequence[str], need: int, block: int) -> DataFrame:
    """groups..., _rep, `_list` of the `need` nearest (distance, id) of every query representative."""
    known, asked = placed.count(), q_placed.count()
    first = placed.select(F.size("_vec")).first()
    cores = placed.sparkSession.sparkContext.defaultParallelism
    q_shares, p_shares = _shares(asked, known, first[0] if first else 1, block, cores)

    def key(cell: str) -> Column:
        return F.to_json(F.struct(*groups, F.col(cell).alias("_cell"))).alias("_key")

    def empty(name: str) -> Column:
        return F.lit(None).cast(placed.schema[name].dataType).alias(name)

    task = (F.col("_q") * p_shares + F.col("_p")).alias("_task")
    visits = meets.select(*groups, "_qcell", "_pcell", F.explode(_all_shares(groups, "_qcell", "_qsubs", q_shares)).alias("_q"), "_psubs").select(
        *groups, "_qcell", "_pcell", "_q", F.explode(_all_shares(groups, "_pcell", "_psubs", p_shares)).alias("_p"))
    visits = visits.select(task, F.lit(0).alias("_side"), *groups, key("_qcell"), key("_pcell").alias("_other"), empty("_rep"), empty("_ids"), empty("_vec"))
    none = F.lit(None).cast("string").alias("_other")
    q_rows = _sent(q_placed, meets, groups, "q", q_shares, p_shares).withColumnsRenamed({"_mine": "_q", "_theirs": "_p"}).select(
        task, F.lit(1).alias("_side"), *groups, key("_cell"), none, "_rep", empty("_ids"), "_vec")
    p_rows = _sent(placed, meets, groups, "p", p_shares, q_shares).withColumnsRenamed({"_mine": "_p", "_theirs": "_q"}).select(
        task, F.lit(2).alias("_side"), *groups, key("_cell"), none, "_rep", "_ids", "_vec")
    of_id = placed.schema["_rep"].dataType
    made = T.StructType([*[T.StructField(g, placed.schema[g].dataType) for g in groups], T.StructField("_rep", of_id),
                         T.StructField("_dists", T.ArrayType(T.DoubleType())), T.StructField("_nids", T.ArrayType(of_id))])
    found = visits.unionByName(q_rows).unionByName(p_rows).groupBy("_task").applyInArrow(
        _meet_shares(need, groups, to_arrow_schema(made)), made)
    pairs = F.arrays_zip(F.col("_dists").alias("_dist"), F.col("_nids").alias("_nid"))
    if p_shares == 1:
        return found.select(*groups, "_rep", pairs.alias("_list"))
    # at most `need` entries per share of the points
    return found.groupBy(*groups, "_rep").agg(F.slice(F.sort_array(F.flatten(F.collect_list(pairs))), 1, need).alias("_list"))


def knn_join(
    points: DataFrame,
    k: int,
    id_col: str,
    vec_col: str,
    groups: Sequence[str] = (),
    queries: DataFrame | None = None,
    exclude_self: bool = True,
    vectors: bool = False,
    block: int = BLOCK,
    pivots: int = MOST_PIVOTS,
) -> DataFrame:
    """(groups..., id, neighbor, distance, rank[, neighbor_vector]): the k nearest points of every query.

    Ties go to the smaller id. With `groups`, neighbours are of the same group. Without `queries`, the points
    ask for themselves. `exclude_self` drops the point that has the id of the query.
    """
    need = k + 1
    gs = list(groups)
    ship_package(points.sparkSession)
    base = points.select(*gs, F.col(id_col).alias("_id"), F.col(vec_col).alias("_vec"))
    asked = base if queries is None else queries.select(*gs, F.col(id_col).alias("_id"), F.col(vec_col).alias("_vec"))
    reps = _representatives(base, gs, need)
    pivots = max(1, min(pivots, math.ceil(base.count() / block)))
    centres = [r["_vec"] for r in reps.orderBy(hash_key("_rep", "pivot"), "_rep").limit(pivots).collect()]
    spark = points.sparkSession
    out_type = f"{points.schema[id_col].dataType.simpleString()}"
    if not centres:
        schema = ", ".join([*[f"{g} {points.schema[g].dataType.simpleString()}" for g in gs],
                            f"id {out_type}, neighbor {out_type}, distance double, rank int"])
        return spark.createDataFrame([], schema + (", neighbor_vector array<double>" if vectors else ""))
    placing = Pivots(np.array(centres, dtype="float64"))
    placed = cut_lineage(_place(reps, placing))
    if queries is None:
        q_reps, q_placed = reps, placed
    else:
        q_reps = _representatives(asked, gs, 1)
        q_placed = cut_lineage(_place(q_reps, placing))
    meets = cut_lineage(_visits(placed, q_placed, gs, placing, need, block))
    near = _search(placed, q_placed, meets, gs, need, block)
    # merged: the planner takes rows that Python made for as small as what Python was given and would send them through the driver
    answers = near.hint("merge").join(q_placed.select(*gs, "_rep", "_vec"), [*gs, "_rep"])
    rows_out = _attach(asked, answers, gs)
    others = F.filter("_list", lambda e: e["_nid"] != F.col("_id")) if exclude_self else F.col("_list")
    listed = rows_out.select(*gs, "_id", F.posexplode(F.slice(others, 1, k)).alias("_pos", "_e"))
    out = listed.select(*gs, F.col("_id").alias("id"), F.col("_e._nid").alias("neighbor"), F.col("_e._dist").alias("distance"),
                        (F.col("_pos") + 1).alias("rank"))
    if not vectors:
        return out
    return out.hint("merge").join(base.select(F.col("_id").alias("neighbor"), F.col("_vec").alias("neighbor_vector")), "neighbor").select(
        *out.columns, "neighbor_vector")


def _attach(asked: DataFrame, answers: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Every query row meets the answer of its representative; vectors with very many copies are salted."""
    keys = [*groups, "_vec"]
    copies = asked.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_COPIES)
    salts = copies.select(*keys, F.ceil(F.col("_n") / HOT_COPIES).cast("int").alias("_salts"))
    if salts.isEmpty():
        return asked.hint("merge").join(answers, keys)
    salts = broadcast_if_small(salts)
    salted = asked.join(salts, keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64("_id"), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    spread = answers.join(salts, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return salted.hint("merge").join(spread, [*keys, "_salt"])
