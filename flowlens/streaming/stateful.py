"""Features that look back over the rows of a source, and counts per target, over micro-batches.

Sequences and rolling features carry the last rows of every source from batch to batch (`events.with_history`); inside a batch they
are the blocked windows of the operators for tables. The repeat counter is a value in the state store per target.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowlens.operators.features import SEQUENCE_LENGTH, SHORT_FLOW, WINDOWS, add_rolling, rolling_names, with_sequence
from flowlens.session import ship_package
from flowlens.streaming.events import with_history

HISTORY = ("flow_bytes_per_s", "flow_packets_per_s", "flow_duration", "syn_flag_count", "rst_flag_count", "destination_port")
# For queries with `count_repeats`: the store with values that expire; and no batches without rows, of which a query with processing time
# would run one after another for ever.
COUNTER_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
DAY_MS = 24 * 3600 * 1000


def _joined(batch: DataFrame, before: DataFrame | None, columns: Sequence[str]) -> DataFrame:
    now = batch.select(*columns, F.lit(True).alias("_new"))
    return now if before is None else now.unionByName(before.select(*columns, F.lit(False).alias("_new")))


def sequence_history(stream: DataFrame, columns: Sequence[str], path: str, source: str = "source_file", order_col: str = "row_id",
                     length: int = SEQUENCE_LENGTH) -> DataFrame:
    """(source, row id, sequence): the last `length` vectors, null until the source has that many rows."""
    def function(batch: DataFrame, before: DataFrame | None) -> DataFrame:
        rows = _joined(batch, before, [source, order_col, *columns])
        made = with_sequence(rows, columns, length, source, order_col)
        return made.where("_new").select(source, order_col, "sequence")

    return with_history(stream, path, function, length - 1, columns, source, order_col)


def rolling_history(stream: DataFrame, path: str, windows: Sequence[int] = WINDOWS, source: str = "source_file",
                    order_col: str = "row_id", short_limit: float = SHORT_FLOW) -> DataFrame:
    """The window features of a source, with the rows of earlier batches in view."""
    def function(batch: DataFrame, before: DataFrame | None) -> DataFrame:
        rows = _joined(batch, before, [source, order_col, *HISTORY])
        made = add_rolling(rows, windows, source, order_col, short_limit)
        return made.where("_new").select(source, order_col, *rolling_names(windows))

    return with_history(stream, path, function, max(windows) - 1, HISTORY, source, order_col)


class RepeatCounter(StatefulProcessor):
    """Running hits of a target; the count is forgotten when the target has no hit for `ttl_ms` of processing time."""

    def __init__(self, out: str, ttl_ms: int):
        self.out, self.ttl_ms = out, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "hits long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [(np.asarray(a), np.asarray(b)) for pdf in rows for a, b in zip(pdf["orders"], pdf["hits"], strict=True)]
        orders, hits = (np.concatenate(c) for c in zip(*parts, strict=True))
        place = np.argsort(orders, kind="stable")
        before = self.total.get()[0] if self.total.exists() else 0
        counted = before + np.cumsum(hits[place])
        if hits.any():
            self.total.update((int(counted[-1]),))
        yield pd.DataFrame({"_key": key[0], "_order": orders[place], self.out: counted})

    def close(self) -> None:
        pass


def count_repeats(stream: DataFrame, key: str, order_col: str, hit: str, out: str = "repeat_offense_count",
                  ttl_ms: int = DAY_MS) -> DataFrame:
    """(key, order, running number of hits of the key), a streaming table in append mode, to be started with COUNTER_SETTINGS.

    A task packs its rows to one row of numbers per key before they are shuffled, so a hot key arrives as few rows of numbers, and only
    keys of a batch touch their state. Rows must arrive in order across batches. Rows without a key are counted together.
    """
    ship_package(stream.sparkSession)
    kind = stream.schema[key].dataType

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            groups = pdf.groupby("_key", dropna=False, sort=False)
            rows = [(k, g["_order"].to_numpy(), g["_hit"].to_numpy()) for k, g in groups]
            yield pd.DataFrame(rows, columns=["_key", "orders", "hits"])

    numbers = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("_key", kind), T.StructField("orders", numbers), T.StructField("hits", numbers)])
    rows = stream.select(F.col(key).alias("_key"), F.col(order_col).cast("long").alias("_order"), F.col(hit).cast("long").alias("_hit"))
    made = T.StructType([T.StructField("_key", kind), T.StructField("_order", T.LongType()), T.StructField(out, T.LongType())])
    counted = rows.mapInPandas(packed, schema).groupBy("_key").transformWithStateInPandas(
        statefulProcessor=RepeatCounter(out, ttl_ms), outputStructType=made, outputMode="append", timeMode="processingTime")
    return counted.select(F.col("_key").alias(key), F.col("_order").alias(order_col), out)
