"""What a streaming run reports of itself: a listener turns progress events into the table of batch latencies."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from flowlens.operators.views import latency_summary

LOG = "query_id string, batch_id long, rows long, latency_ms double, ended_at string"


@dataclass
class ProgressLog(StreamingQueryListener):
    """One row per micro-batch with rows, kept until they are written: (query, batch, rows, milliseconds, end).

    Events come on a thread of their own, after the batch; `wait` returns when the queries that started have reported their end.
    """

    rows: list[tuple] = field(default_factory=list)
    started: set[str] = field(default_factory=set)
    ended: set[str] = field(default_factory=set)
    changed: threading.Condition = field(default_factory=threading.Condition)

    def onQueryStarted(self, event) -> None:
        with self.changed:
            self.started.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            with self.changed:
                self.rows.append((str(p.id), int(p.batchId), int(p.numInputRows), float(p.durationMs["triggerExecution"]), p.timestamp))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.ended.add(str(event.runId))
            self.changed.notify_all()

    def wait(self, seconds: float = 60.0) -> bool:
        with self.changed:
            return self.changed.wait_for(lambda: bool(self.started) and self.started <= self.ended, seconds)

    def table(self, spark: SparkSession) -> DataFrame:
        """The batches so far; a batch that was repeated counts as it ended."""
        last = {(q, b): (q, b, n, ms, at) for q, b, n, ms, at in self.rows}
        return spark.createDataFrame(list(last.values()), LOG)


@contextmanager
def watched(spark: SparkSession) -> Iterator[ProgressLog]:
    """A log of all streaming queries that run inside."""
    log = ProgressLog()
    spark.streams.addListener(log)
    try:
        yield log
    finally:
        log.wait()
        spark.streams.removeListener(log)


def timed(spark: SparkSession, run: Callable[[], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The result of a streaming run and its latency table."""
    with watched(spark) as log:
        out = run()
    return out, log.table(spark)


def summary(log: DataFrame) -> DataFrame:
    """rows_streamed, batches, mean and p95 batch latency, throughput, time of the last batch."""
    one = F.lit(1).alias("_k")
    last = log.agg(F.max("ended_at").alias("end_time")).select("*", one)
    return latency_summary(log).select("*", one).join(F.broadcast(last), "_k").select(
        F.col("total_rows").alias("rows_streamed"), F.col("total_calls").alias("batches"),
        F.col("mean_ms").alias("mean_batch_latency_ms"), F.col("p95_ms").alias("p95_batch_latency_ms"),
        F.col("rows_per_second").alias("throughput_rows_per_second"), "end_time")
