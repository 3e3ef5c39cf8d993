"""Order-dependent building blocks that never put one key into one task.

A window over a hot key sorts that whole key in one task. The helpers here cut each key into blocks,
aggregate the blocks, prefix-sum the block totals, and finish inside each block.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.functions.local import local_table
from flowlens.functions.columns import hash_key

BLOCK_ROWS = 32_768
MAX_BROADCAST_ROWS = 20_000


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A table that proves small is read once and broadcast by value; a larger one keeps the planner's join choice."""
    rows = df.limit(max_rows + 1).collect()
    return F.broadcast(local_table(df.sparkSession, rows, df.schema)) if len(rows) <= max_rows else df


def with_block(df: DataFrame, order_col: str, block_rows: int) -> DataFrame:
    return df.withColumn("_blk", F.expr(f"cast({order_col} as bigint) div {int(block_rows)}"))


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order_col: str,
    sums: Mapping[str, Column],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Inclusive running sums per key in the order of a unique integer column."""
    names = list(sums)
    # a struct is never null, so rows without a key meet too, and join and window share one shuffle
    blocked = with_block(df, order_col, block_rows).withColumn("_key", F.struct(*keys) if keys else F.lit(0))
    totals = blocked.groupBy("_key", "_blk").agg(*[F.sum(sums[n]).alias(f"_t_{n}") for n in names])
    before = Window.partitionBy("_key").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_key", "_blk", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in names])
    inside = Window.partitionBy("_key", "_blk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    return blocked.join(offsets, ["_key", "_blk"]).select(
        *df.columns,
        *[(F.col(f"_o_{n}") + F.coalesce(F.sum(sums[n]).over(inside), F.lit(0))).alias(n) for n in names],
    )


def dense_index(
    df: DataFrame, keys: Sequence[str], order_col: str, out: str = "_idx", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Row number per key (from 1) in the order of a unique integer column."""
    return running_sums(df, keys, order_col, {out: F.lit(1).cast("bigint")}, block_rows)


def value_prefix(
    df: DataFrame,
    keys: Sequence[str],
    value_col: str,
    counts: Sequence[str],
    buckets: int = 128,
) -> DataFrame:
    """For rows unique per (keys, value): sums of `counts` over smaller values, as `<name>_lt`.

    Buckets are cut at approximate quantiles, so equal numbers of distinct values meet in a task.
    `keys` name columns of a table or classes of a vocabulary: the cut points are one row per key and
    the bucket totals at most `buckets + 1` rows per key, which is what bounds the broadcasts.
    """
    ks = list(keys)
    base = df if ks else df.withColumn("_one", F.lit(0))
    ks = ks or ["_one"]
    probs = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    cuts = base.groupBy(*ks).agg(F.percentile_approx(value_col, probs, F.lit(10_000)).alias("_cuts"))
    placed = base.join(F.broadcast(cuts), ks).withColumn(
        "_bkt", F.expr(f"size(filter(_cuts, b -> b < `{value_col}`))")
    ).drop("_cuts")
    totals = placed.groupBy(*ks, "_bkt").agg(*[F.sum(c).alias(f"_t_{c}") for c in counts])
    before = Window.partitionBy(*ks).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *ks, "_bkt", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in counts]
    )
    inside = Window.partitionBy(*ks, "_bkt").orderBy(value_col).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(offsets), [*ks, "_bkt"])
    return out.select(
        *df.columns,
        *[(F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_lt") for c in counts],
    )


def class_sizes(df: DataFrame, class_col: str, max_classes: int = 10_000) -> dict:
    """Rows per class, on the driver; the number of classes is checked first."""
    counted = df.groupBy(class_col).count()
    rows = counted.limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        raise ValueError(f"{class_col} has more than {max_classes} values and is no class column")
    return {r[0]: r["count"] for r in sorted(rows, key=lambda r: (r[0] is None, r[0]))}


EDGE_ROWS = 65_536
DIGITS = 3  # hex digits of a key that one round of counting looks at


def hash_thresholds(
    df: DataFrame, class_col: str, row_id: str, quotas: Mapping, seed: int | str, edge_rows: int = EDGE_ROWS
) -> DataFrame:
    """Per class, the hash key of the last row inside the quota: one row per class.

    Rows are counted by the first hex digits of their key, then those with the digits of the quota's edge by the next ones, until
    no class has more than `edge_rows` rows there; only these are sorted. A round is one row per class on the driver.
    """
    spark = df.sparkSession
    class_type = df.schema[class_col].dataType.simpleString()
    schema = f"_class {class_type}, _prefix string, _rest bigint"
    edge = [(c, "", int(q)) for c, q in quotas.items() if q > 0]
    keyed = df.select(F.col(class_col).alias("_class"), hash_key(row_id, seed).alias("_key"), F.col(row_id).alias("_rid"))
    length, most = 0, None
    while edge and length < 30 and (most is None or most > edge_rows):
        within = keyed.join(F.broadcast(local_table(spark, edge, schema)), "_class").where(
            F.substring("_key", 1, length) == F.col("_prefix"))
        length += DIGITS
        counted = within.groupBy("_class", "_rest", F.substring("_key", 1, length).alias("_prefix")).agg(F.count("*").alias("_n"))
        upto = Window.partitionBy("_class").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)
        every = Window.partitionBy("_class")
        summed = counted.withColumn("_cum", F.sum("_n").over(upto)).withColumn("_rest", F.least("_rest", F.sum("_n").over(every)))
        at = summed.where((F.col("_cum") >= F.col("_rest")) & (F.col("_cum") - F.col("_n") < F.col("_rest")))
        found = at.select("_class", "_prefix", (F.col("_rest") - (F.col("_cum") - F.col("_n"))).alias("_rest"), "_n").collect()
        edge = [tuple(r)[:3] for r in found]
        most = max((r["_n"] for r in found), default=0)
    within = keyed.join(F.broadcast(local_table(spark, edge, schema)), "_class").where(F.substring("_key", 1, length) == F.col("_prefix"))
    rn = F.row_number().over(Window.partitionBy("_class").orderBy("_key", "_rid"))
    return within.withColumn("_rn", rn).where(F.col("_rn") == F.col("_rest")).select(
        "_class", F.col("_key").alias("_last_key"), F.col("_rid").alias("_last_rid"))


def hash_cut(
    df: DataFrame, class_col: str, row_id: str, quotas: Mapping, seed: int | str, flag: str | None = None
) -> DataFrame:
    """The quota of rows per class with the smallest hash keys, or a flag column marking them.

    A class whose quota covers all its rows is kept whole; a class without quota is dropped.
    No wide row is shuffled: the thresholds, one per class in `quotas`, are broadcast.
    """
    last = hash_thresholds(df, class_col, row_id, quotas, seed)
    last = F.broadcast(last) if len(quotas) <= MAX_BROADCAST_ROWS else last
    key = hash_key(row_id, seed)
    inside = F.coalesce(
        (key < F.col("_last_key")) | ((key == F.col("_last_key")) & (F.col(row_id) <= F.col("_last_rid"))),
        F.lit(False),
    )
    out = df.join(last, F.col(class_col).eqNullSafe(F.col("_class")), "left")
    if flag:
        return out.withColumn(flag, inside).select(*df.columns, flag)
    return out.where(inside).select(*df.columns)


def exact_quantiles(
    df: DataFrame, value_col: str, quantiles: Sequence[float], keys: Sequence[str] = (), buckets: int = 128
) -> DataFrame:
    """One row per key with exact quantiles `q0`, `q1`, ..., interpolated between neighbouring rows.

    Equal values are counted first and the counts are prefix-summed in buckets; `percentile` would hold
    every distinct value of a key in one buffer.
    """
    ks = list(keys)
    counted = df.where(F.col(value_col).isNotNull()).groupBy(*ks, value_col).agg(F.count("*").alias("_n"))
    ranked = value_prefix(counted, ks, value_col, ["_n"], buckets)
    totals = counted.groupBy(*ks).agg(F.sum("_n").alias("_all"))
    # one row per key
    placed = ranked.withColumn("_k", F.lit(1)).join(F.broadcast(totals.withColumn("_k", F.lit(1))), [*ks, "_k"])
    made = []
    for i, q in enumerate(quantiles):
        at = F.lit(float(q)) * (F.col("_all") - 1)
        low = F.floor(at)
        high = F.least(low + 1, F.col("_all") - 1)

        def value_at(rank):
            inside = (F.col("_n_lt") <= rank) & (rank < F.col("_n_lt") + F.col("_n"))
            return F.max(F.when(inside, F.col(value_col)))

        made += [value_at(low).alias(f"_l{i}"), value_at(high).alias(f"_h{i}"), F.max(at - low).alias(f"_f{i}")]
    found = placed.groupBy(*ks).agg(*made)
    return found.select(*ks, *[
        (F.col(f"_l{i}") + F.col(f"_f{i}") * (F.col(f"_h{i}") - F.col(f"_l{i}"))).alias(f"q{i}")
        for i in range(len(quantiles))])
