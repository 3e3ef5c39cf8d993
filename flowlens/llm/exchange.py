"""Exchange of packed number columns between tasks, kept extra columns, and connected components.

Python tasks that trade hundreds of millions of small numbers pack them: a task sends each shard one row of byte strings
instead of a row per number. A shard is a value of the `shard` column; Spark shuffles and groups by it.
"""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.llm.kernels import mix
from flowlens.session import cut_lineage, staging_path

SHARDS_PER_PARTITION = 2
FLUSH_BYTES = 32 << 20


def shard_count(spark: SparkSession) -> int:
    """Shards grow with the number of shuffle partitions, which the user sizes by the data."""
    return SHARDS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))


def reply_count(spark: SparkSession) -> int:
    """Shards of answers: every shard may answer every one of these, so they are no more than needed."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) >> np.uint64(33)).astype(np.int64) % shards


def doc_shard(docs: np.ndarray, shards: int) -> np.ndarray:
    return shard_of(docs.view(np.uint64) + np.uint64(0x51ED2701), shards)


def pack(shard: np.ndarray, shards: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch | None:
    """One row per shard that has values: shard and the bytes of each column, in the order given within a shard."""
    if not len(shard):
        return None
    order = np.argsort(shard.astype(np.uint16) if shards <= 65536 else shard, kind="stable")
    counts = np.bincount(shard, minlength=shards)
    full = np.flatnonzero(counts)
    ends = np.cumsum(counts[full])
    out = {"shard": pa.array(full.astype(np.int32))}
    for name, values in columns.items():
        values = np.ascontiguousarray(values[order])
        width = values.dtype.itemsize
        offsets = np.concatenate([[0], ends * width]).astype(np.int64)
        out[name] = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(full), [None, pa.py_buffer(offsets), pa.py_buffer(values)]).cast(pa.binary())
    return pa.RecordBatch.from_pydict(out)


def unpack(column, dtype) -> np.ndarray:
    """The numbers of all rows of a packed column, one row after another."""
    parts = [np.frombuffer(v, dtype) for v in column.to_pylist() if v]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def packed_schema(*names: str) -> str:
    return "shard int, " + ", ".join(f"{n} binary" for n in names)


def release() -> None:
    """Gives freed memory back to the system. A Python worker is used again by later tasks and would keep its peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(function):
    """`function` of mapInArrow or applyInArrow, with its memory released when the task or group is done."""

    def run(given):
        if isinstance(given, pa.Table):
            release()  # the group before this one is gone by now
            return function(given)
        return _released(function(given))

    return run


def _released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    try:
        yield from batches
    finally:
        release()


class Collector:
    """Gathers arrays over the batches of a task and hands them on in portions of about FLUSH_BYTES."""

    def __init__(self, emit, limit: int = FLUSH_BYTES):
        self.emit, self.limit, self.parts, self.size = emit, limit, [], 0

    def add(self, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(arrays[0]):
            self.parts.append(arrays)
            self.size += sum(a.nbytes for a in arrays)
        if self.size >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            joined = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
            self.parts, self.size = [], 0
            made = iter(self.emit(*joined))
            del joined
            for batch in made:
                if batch is not None:
                    yield batch


def keep_rest(df: DataFrame, *used: str) -> DataFrame:
    """`used` as they are, all other columns in the struct `_rest`, which no name of an operator can clash with."""
    others = [c for c in df.columns if c not in used]
    rest = F.struct(*[F.col(f"`{c}`").alias(c) for c in others]) if others else F.struct(F.lit(1).alias("_none"))
    return df.select(*[F.col(f"`{c}`") for c in used], rest.alias("_rest"))


def give_rest(df: DataFrame, *made: str) -> DataFrame:
    """The columns of `_rest` again, except those that the operator makes itself."""
    others = [c for c in df.schema["_rest"].dataType.names if c not in {*made, "_none"} and c not in df.columns]
    return df.select("*", *[F.col("_rest").getField(c).alias(c) for c in others]).drop("_rest")


def staged(make, name: str, spark: SparkSession) -> DataFrame:
    """What `make()` returns, written to the shared folder and read again: later steps read it from there, also after an
    executor is lost.

    `make` builds the frame inside, so nothing refers to its plan afterwards and Spark can delete the shuffle files behind
    it; the collection request lets it do so now rather than when the driver's heap fills.
    """
    path = staging_path(spark, name)
    df = make()
    schema = df.schema
    df.write.parquet(path)
    del df, make
    for _ in range(2):  # the first collection may meet the finished query in the hands of Spark's listeners
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
    return spark.read.schema(schema).parquet(path)


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """node, component (the smallest node reachable) for every node of `edges` (a, b).

    Alternates the large-star and small-star steps: each round links every node to the smallest neighbour it knows,
    which keeps the number of edges below that of the input and ends after a logarithmic number of rounds.
    """
    now = cut_lineage(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = _digest(now)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = cut_lineage(small.where("u <> v").distinct())
        before, seen = seen, _digest(now)
        if before == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return row[0], row[1]
