"""Chat logs to training texts: logged snapshots of a growing conversation collapse to the longest one, then each is rendered.

A conversation is logged again and again while it grows, so many logs are prefixes of longer ones. A turn's hash takes its
place, role and text; the hash of a prefix is the exclusive-or of its turns' hashes (two of 64 bits), a running aggregate. A log goes
if the prefixes of longer logs hold its whole hash (an anti-join on distinct prefixes, so a first turn that a third of
all logs share is one row), or if an equal log has a smaller conv_id.

Turns are in the order of turn, role, text, nulls last. A very long log is cut into blocks of `BLOCK` turn numbers: running
aggregates run inside blocks and over block totals.

Defined results: a null role or text counts as empty; turns without a conv_id are one log without an id; repeated rows are turns of
their own; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

BLOCK = 1024


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role, text, p1, p2: the hash of the turns up to this one."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(1 << 60)))
    inner = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = rows.withColumn("nth", F.row_number().over(inner))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.count("*").alias("many")).withColumn(
        "base", F.coalesce(F.sum("many").over(before), F.lit(0)))

    def with_base(rows, totals, *names):
        other = totals.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), *names)
        return rows.join(other, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))).drop("_c", "_b")

    rows = with_base(rows, blocks, "base").withColumn("place", F.col("base") + F.col("nth"))
    rows = rows.withColumn("h1", F.xxhash64("place", "role", "text")).withColumn(
        "h2", F.xxhash64(F.lit("other"), "text", "role", "place"))
    running = inner.rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2")).withColumn(
        "b1", F.coalesce(F.bit_xor("x1").over(before), F.lit(0))).withColumn(
        "b2", F.coalesce(F.bit_xor("x2").over(before), F.lit(0)))
    rows = with_base(rows, sums, "b1", "b2")
    return rows.select(
        "conv_id", "place", "role", "text", F.col("b1").bitwiseXOR(F.bit_xor("h1").over(running)).alias("p1"),
        F.col("b2").bitwiseXOR(F.bit_xor("h2").over(running)).alias("p2"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of the logs that are no prefix of a longer log, the smallest conv_id of equal ones."""
    rows = numbered(turns)
    ends = rows.groupBy("conv_id").agg(F.max(F.struct("place", "p1", "p2")).alias("e")).select(
        "conv_id", F.col("e.place").alias("place"), F.col("e.p1").alias("p1"), F.col("e.p2").alias("p2"))
    own = ends.select(F.col("conv_id").alias("_c"), F.col("place").alias("n"))
    proper = rows.select("conv_id", "place", "p1", "p2").join(own, F.col("conv_id").eqNullSafe(F.col("_c"))).where(
        "place < n").select("place", "p1", "p2").distinct()
    kept = ends.groupBy("place", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    return kept.join(proper, ["place", "p1", "p2"], "left_anti").select("conv_id", F.col("place").alias("n_turns"), "n_equal")


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_equal (logs equal to this one, itself included) and the rendered text of every maximal log."""
    kept = maximal(turns).withColumnRenamed("conv_id", "_k")
    turn = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    rows = numbered(turns).select("conv_id", "place", turn.alias("line"))
    rows = rows.join(kept, F.col("conv_id").eqNullSafe(F.col("_k")))
    return rows.groupBy("conv_id", "n_turns", "n_equal").agg(
        F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines")).select(
        "conv_id", "n_turns", "n_equal", F.array_join(F.col("lines.line"), "").alias("text"))
