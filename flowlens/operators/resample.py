"""Class balancing with synthetic rows between neighbours. Every choice is a hash of row, copy and seed."""

from __future__ import annotations

import math
import statistics
from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from flowlens.functions.columns import hash_unit
from flowlens.operators.neighbors import knn_join
from flowlens.operators.ordering import class_sizes, hash_cut
from flowlens.session import cut_lineage
from flowlens.operators.splits import SEED, cap_classes

NEIGHBORS = 5


def neighbor_lists(df: DataFrame, k: int, id_col: str, vec_col: str, class_col: str) -> DataFrame:
    """Each row with the vectors of its nearest rows of the same class, nearest first."""
    found = knn_join(df, k, id_col, vec_col, [class_col], vectors=True)
    lists = found.groupBy(F.col("id").alias(id_col)).agg(
        F.sort_array(F.collect_list(F.struct("rank", "neighbor", "neighbor_vector"))).alias("_near"))
    return df.join(lists, id_col)


def interpolate(rows: DataFrame, id_col: str, vec_col: str, class_col: str, copies: str, seed: int) -> DataFrame:
    """`copies` new rows per row, each between the row and one of its neighbours in `_near`."""
    made = rows.where(F.col(copies) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    pick = F.floor(hash_unit(id_col, "copy", F.lit(f"{seed}-n")) * F.size("_near")) + 1
    made = made.withColumn("_n", F.element_at("_near", pick.cast("int"))).withColumn(
        "_gap", hash_unit(id_col, "copy", F.lit(f"{seed}-u")))
    vec = F.zip_with(vec_col, F.col("_n.neighbor_vector"), lambda x, y: x + F.col("_gap") * (y - x))
    return made.select(id_col, class_col, "copy", F.col("_n.neighbor").alias("neighbor"), vec.alias(vec_col))


def even_copies(df: DataFrame, class_col: str, id_col: str, wanted: Mapping, sizes: Mapping, seed: int) -> DataFrame:
    """`copies` per row: the same for all rows of a class, and one more for as many as the division leaves."""
    base = {c: n // sizes[c] for c, n in wanted.items()}
    rest = {c: n - base[c] * sizes[c] for c, n in wanted.items()}
    marked = hash_cut(df, class_col, id_col, rest, f"{seed}-r", "_extra")
    per = F.lit(0)
    for c, n in base.items():
        per = F.when(F.col(class_col) == c, F.lit(n)).otherwise(per)
    return marked.withColumn("copies", per + F.col("_extra").cast("int")).drop("_extra")


def smote(df: DataFrame, class_col: str, id_col: str, vec_col: str, wanted: Mapping, k: int = NEIGHBORS,
          seed: int = SEED) -> DataFrame:
    """Synthetic rows, `wanted[class]` of them, for classes with at least two rows."""
    sizes = class_sizes(df, class_col)
    usable = {c: n for c, n in wanted.items() if n > 0 and sizes.get(c, 0) >= 2}
    members = df.where(F.col(class_col).isin(list(usable))).select(id_col, class_col, vec_col)
    counted = even_copies(members, class_col, id_col, usable, sizes, seed)
    with_near = neighbor_lists(members, k, id_col, vec_col, class_col)
    rows = with_near.join(counted.select(id_col, "copies"), id_col)
    return interpolate(rows, id_col, vec_col, class_col, "copies", seed)


def smote_targets(sizes: Mapping, benign, target: int, cap: int) -> dict:
    """New rows per attack class: up to min(max(size, target), cap)."""
    out = {}
    for c, n in sizes.items():
        wanted = min(max(n, target), cap) - n
        if c != benign and n >= 2 and wanted > 0:
            out[c] = wanted
    return out


def difficulty(df: DataFrame, class_col: str, id_col: str, vec_col: str, minority, k: int = NEIGHBORS) -> DataFrame:
    """Share of other classes among the k nearest rows of each minority row."""
    minor = df.where(F.col(class_col) == minority)
    found = knn_join(df, k, id_col, vec_col, queries=minor)
    # neighbours carry no class: one look-up by id, many rows per neighbour at most k times its in-degree
    kinds = df.select(F.col(id_col).alias("neighbor"), (F.col(class_col) != minority).cast("int").alias("_major"))
    return found.join(kinds, "neighbor").groupBy(F.col("id").alias(id_col)).agg(
        F.sum("_major").alias("majority_neighbors"), F.count("*").alias("neighbors"))


def adasyn_copies(scores: DataFrame, id_col: str, generate: int, seed: int) -> DataFrame | None:
    """`copies` per minority row in proportion to its difficulty; None when no row is difficult.

    The difficulty has at most k + 1 values, so the allocation is decided per value on the driver: whole
    parts first, what is left to the most difficult rows.
    """
    leveled = scores.withColumn("level", F.col("majority_neighbors") / F.col("neighbors"))
    sizes = {k: v for k, v in class_sizes(leveled, "level").items() if k is not None}
    total = sum(level * n for level, n in sizes.items())
    if total == 0:
        return None
    base = {level: math.floor(level / total * generate) for level in sizes}
    rest = generate - sum(base[level] * n for level, n in sizes.items())
    extra = {}
    for level in sorted(sizes, reverse=True):
        extra[level] = min(rest, sizes[level])
        rest -= extra[level]
    marked = hash_cut(leveled, "level", id_col, extra, f"{seed}-r", "_extra")
    per = F.lit(0)
    for level, n in base.items():
        per = F.when(F.col("level") == level, F.lit(n)).otherwise(per)
    return marked.withColumn("copies", per + F.col("_extra").cast("int")).drop("_extra")


def adasyn(df: DataFrame, class_col: str, id_col: str, vec_col: str, minority, majority, ratio: float = 1.0,
           k: int = NEIGHBORS, seed: int = SEED) -> DataFrame | None:
    """Synthetic minority rows up to `ratio` times the majority; None where nothing is to be made."""
    sizes = class_sizes(df, class_col)
    few, many = sizes.get(minority, 0), sizes.get(majority, 0)
    target = round(many * ratio)  # half to even
    if few >= target or few < 2:
        return None
    generate = target - few
    scores = cut_lineage(difficulty(df, class_col, id_col, vec_col, minority, k))
    copies = adasyn_copies(scores, id_col, generate, seed)
    if copies is None:
        return smote(df, class_col, id_col, vec_col, {minority: generate}, k, seed)
    minor = df.where(F.col(class_col) == minority).select(id_col, class_col, vec_col)
    rows = neighbor_lists(minor, k, id_col, vec_col, class_col).join(copies.select(id_col, "copies"), id_col)
    return interpolate(rows, id_col, vec_col, class_col, "copies", seed)


def with_synthetic(df: DataFrame, made: DataFrame | None, id_col: str, vec_col: str, class_col: str) -> DataFrame:
    """Original rows (copy 0) and synthetic ones."""
    whole = df.select(id_col, class_col, F.lit(0).alias("copy"), vec_col)
    return whole if made is None else whole.unionByName(made.select(id_col, class_col, "copy", vec_col))


def balance_binary(df: DataFrame, class_col: str, id_col: str, vec_col: str, majority_cap: int = 500_000,
                   ratio: float = 1.0, k: int = NEIGHBORS, seed: int = SEED) -> DataFrame:
    """Majority (0) capped, minority (1) capped at the majority, then synthetic minority rows."""
    sizes = class_sizes(df, class_col)
    few, many = sizes.get(1, 0), sizes.get(0, 0)
    kept_many = min(many, max(majority_cap, few))
    capped = cut_lineage(cap_classes(df, class_col, id_col, {0: kept_many, 1: kept_many}, seed))
    made = adasyn(capped, class_col, id_col, vec_col, 1, 0, ratio, k, seed)
    return with_synthetic(capped, made, id_col, vec_col, class_col)


def balance_multiclass(df: DataFrame, class_col: str, id_col: str, vec_col: str, benign=0, benign_cap: int = 500_000,
                       attack_cap: int = 100_000, min_target: int = 20_000, k: int = NEIGHBORS,
                       seed: int = SEED) -> DataFrame:
    """Classes capped, then attack classes filled up to the larger of the minimum and their median size."""
    sizes = class_sizes(df, class_col)
    caps = {c: benign_cap if c == benign else attack_cap for c in sizes}
    capped = cut_lineage(cap_classes(df, class_col, id_col, caps, seed))
    kept = {c: min(n, caps[c]) for c, n in sizes.items()}
    attacks = [n for c, n in kept.items() if c != benign]
    target = max(min_target, int(statistics.median(attacks))) if attacks else min_target
    wanted = smote_targets(kept, benign, target, attack_cap)
    made = smote(capped, class_col, id_col, vec_col, wanted, k, seed) if wanted else None
    return with_synthetic(capped, made, id_col, vec_col, class_col)
