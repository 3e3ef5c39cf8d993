"""Tables an operations team reads: recent rows, counts, confusion, curves, pages, latency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from flowlens.functions.local import local_table
from flowlens.functions import vocab
from flowlens.operators.ordering import dense_index, exact_quantiles

MAX_PAGE = 1000


def recent(df: DataFrame, n: int, order_col: str = "stream_order") -> DataFrame:
    """The last n rows, newest first."""
    return df.orderBy(F.desc(order_col)).limit(max(n, 0))


def counts_by_level(scored: DataFrame) -> DataFrame:
    """A row for each alert level, also where there are no rows."""
    levels = local_table(scored.sparkSession, [(v,) for v in vocab.LEVELS], "alert_level string")
    found = scored.groupBy("alert_level").agg(F.count("*").alias("count"))
    return levels.join(found, "alert_level", "left").fillna(0, ["count"])


def attack_distribution(alerts: DataFrame) -> DataFrame:
    found = alerts.groupBy(F.col("predicted_multiclass_label_name").alias("attack_type")).agg(F.count("*").alias("count"))
    return found.orderBy(F.desc("count"), "attack_type")


def binary_confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row per actual class, one column per predicted class; both classes always there."""
    counted = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    rows = local_table(df.sparkSession, [(0, "Actual BENIGN"), (1, "Actual ATTACK")], "t int, actual string")
    wide = counted.groupBy("t").pivot("p", [0, 1]).agg(F.sum("n"))
    return (
        rows.join(wide, "t", "left")
        .select("actual", F.coalesce("0", F.lit(0)).alias("predicted_benign"),
                F.coalesce("1", F.lit(0)).alias("predicted_attack"))
    )


def confusion_payload(matrix: DataFrame) -> DataFrame:
    """The matrix as one row of index, columns and data arrays."""
    cells = F.sort_array(F.collect_list(F.struct(
        (F.col("actual") != "Actual BENIGN").alias("o"), "actual",
        F.array("predicted_benign", "predicted_attack").alias("data"))))
    return matrix.agg(cells.alias("_r")).select(
        F.transform("_r", lambda r: r.actual).alias("index"),
        F.array(F.lit("Predicted BENIGN"), F.lit("Predicted ATTACK")).alias("columns"),
        F.transform("_r", lambda r: r.data).alias("data"),
    )


def compact_confusion(
    df: DataFrame, truth: str, predicted: str, order_col: str, top_k: int = 8, other: str = "OTHER"
) -> DataFrame:
    """Long confusion matrix over BENIGN and the most frequent other labels, the rest folded.

    The folded bucket exists only where some actual label is folded; without it, predictions outside the
    shown labels are left out. Labels of equal frequency come in order of first appearance.
    """
    pairs = df.groupBy(F.col(truth).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n"), F.min(order_col).alias("first"))
    keep = max(top_k - 1, 0)
    ranked = (
        pairs.where(F.col("actual") != vocab.BENIGN).groupBy("actual")
        .agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        .orderBy(F.desc("n"), "first").limit(keep + 1).collect()
    )
    shown = [vocab.BENIGN] + [r["actual"] for r in ranked[:keep]]
    labels = shown + ([other] if len(ranked) > keep else [])

    def bucket(name):
        return F.when(F.col(name).isin(shown), F.col(name)).otherwise(F.lit(other))

    found = pairs.groupBy(bucket("actual").alias("actual"), bucket("predicted").alias("predicted")).agg(
        F.sum("n").alias("count"))
    names = F.array(*[F.lit(v) for v in labels])
    grid = local_table(df.sparkSession, [(v,) for v in labels], "actual string").select(
        "actual", F.explode(names).alias("predicted"))
    return grid.join(found, ["actual", "predicted"], "left").fillna(0, ["count"])


def as_matrix(long: DataFrame) -> DataFrame:
    """Wide form of a long confusion matrix."""
    return long.groupBy("actual").pivot("predicted").agg(F.sum("count"))


def alert_timeline(alerts: DataFrame, time_col: str, levels: Sequence[str] = ("Attack", "Suspicious")) -> DataFrame:
    """Alerts per minute and level; rows without a valid time are left out."""
    at = F.col(time_col)
    if isinstance(alerts.schema[time_col].dataType, T.StringType):
        at = F.try_to_timestamp(at)
    minute = F.date_trunc("minute", at)
    placed = alerts.select(minute.alias("minute"), "alert_level").where("minute is not null and alert_level is not null")
    return placed.groupBy("minute").pivot("alert_level", list(levels)).count().fillna(0, list(levels))


def sorted_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy("task", F.desc("f1_score"), F.desc("roc_auc"))


def top_summary(table: DataFrame, n: int, by: str = "mean_abs_contribution") -> DataFrame:
    return (table.orderBy(F.desc(by)) if by in table.columns else table).limit(n)


def overview(scored: DataFrame, latencies: DataFrame) -> DataFrame:
    """One row of headline numbers from the scored table and the run log."""
    risk = scored.agg(
        F.count("*").alias("rows_streamed"), F.count_if("is_alert").alias("alert_rows"),
        F.count_if(F.col("alert_level") == "Attack").alias("attack_alerts"),
        F.avg("risk_score").alias("average_risk_score"), F.max("risk_score").alias("max_risk_score"),
    ).withColumn("_k", F.lit(1))
    runs = latencies.agg(
        F.avg("latency_ms").alias("average_batch_latency_ms"),
        (F.sum("rows") / (F.sum("latency_ms") / 1000.0)).alias("throughput_rows_per_second"),
    ).withColumn("_k", F.lit(1))
    return risk.join(F.broadcast(runs), "_k").drop("_k")


def page(
    scored: DataFrame,
    limit: int,
    offset: int = 0,
    alert_level: str | None = None,
    attack_type: str | None = None,
    min_risk: float | None = None,
    after: int | None = None,
    order_col: str = "stream_order",
) -> DataFrame:
    """One page in row order with `has_more`. `after` continues behind a row and beats a deep offset."""
    limit = min(max(limit, 1), MAX_PAGE)
    rows = scored
    if alert_level is not None:
        rows = rows.where(F.col("alert_level") == alert_level)
    if attack_type is not None:
        rows = rows.where(F.col("predicted_multiclass_label_name") == attack_type)
    if min_risk is not None:
        rows = rows.where(F.col("risk_score").try_cast("double") >= min_risk)
    if after is not None:
        rows = rows.where(F.col(order_col) > after)
    ahead = rows.orderBy(order_col).offset(offset).limit(limit + 1)
    # at most MAX_PAGE + 1 rows are left, so the one partition of these windows is small
    seen = Window.orderBy(order_col)
    whole = Window.partitionBy(F.lit(0))
    return (
        ahead.withColumn("_n", F.row_number().over(seen))
        .withColumn("has_more", F.count("*").over(whole) > limit)
        .where(F.col("_n") <= limit).drop("_n")
    )


def request_problems(requests: DataFrame, features: Sequence[str], id_col: str) -> DataFrame:
    """Records that lack selected features, with the first ten missing names."""
    names = F.array(*[F.lit(f) for f in features])
    missing = F.filter(names, lambda n: ~F.map_contains_key(F.col("features"), n))
    return (
        requests.withColumn("_m", missing).where(F.size("_m") > 0)
        .select(id_col, F.size("_m").alias("missing_count"), F.slice("_m", 1, 10).alias("missing"))
    )


def request_table(requests: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Complete records as columns; the others are left to `request_problems`."""
    full = [F.map_contains_key(F.col("features"), F.lit(f)) for f in features]
    ok = full[0]
    for cond in full[1:]:
        ok = ok & cond
    return requests.where(ok).select(*keep, *[F.col("features")[f].cast("double").alias(f) for f in features])


def latency_summary(log: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Percentiles and throughput of a run log with `rows` and `latency_ms`."""
    ms = F.col("latency_ms")
    sums = log.groupBy(*keys).agg(
        F.sum("rows").alias("total_rows"), F.count("*").alias("total_calls"), F.avg(ms).alias("mean_ms"),
        F.max(ms).alias("max_ms"), (F.sum(ms) / F.greatest(F.sum("rows"), F.lit(1))).alias("mean_row_ms"),
        F.when(F.sum(ms) > 0, F.sum("rows") / (F.sum(ms) / 1000.0)).otherwise(0.0).alias("rows_per_second"),
    ).withColumn("_k", F.lit(1))
    cuts = exact_quantiles(log, "latency_ms", (0.5, 0.95, 0.99), keys).withColumn("_k", F.lit(1))
    return sums.join(cuts, [*keys, "_k"]).select(
        *keys, "total_rows", "total_calls", "mean_ms", F.col("q0").alias("p50_ms"), F.col("q1").alias("p95_ms"),
        F.col("q2").alias("p99_ms"), "max_ms", "mean_row_ms", "rows_per_second")


def best_candidate(candidates: DataFrame, limit_ms: float, key: str = "benchmark") -> DataFrame:
    """Per benchmark the fastest candidate within the limit; where none is within it, the fastest of all.

    A pure aggregate: the best row is the smallest struct, so nothing is sorted or windowed.
    """
    within = F.col("p95_ms") <= limit_ms
    rank = F.struct((~within).alias("over_limit"), (-F.col("rows_per_second")).alias("slow"),
                    F.col("p95_ms"), F.col("candidate_value"))
    best = candidates.groupBy(key).agg(F.min(rank).alias("b"))
    return best.select(key, F.col("b.candidate_value").alias("candidate_value"), F.col("b.p95_ms").alias("p95_ms"),
                       (-F.col("b.slow")).alias("rows_per_second"), (~F.col("b.over_limit")).alias("within_limit"))


def confidence_buckets(df: DataFrame) -> DataFrame:
    c = F.col("multiclass_confidence")
    name = F.when(c >= 0.9, "90-100%").when(c >= 0.75, "75-90%").when(c >= 0.5, "50-75%").otherwise("<50%")
    return df.groupBy(name.alias("name")).agg(F.count("*").alias("value"))


def counts_per_ten(df: DataFrame, order_col: str = "stream_order", size: int = 10) -> DataFrame:
    """Rows per run of ten events, counted from the newest."""
    newest_first = df.select((-F.col(order_col)).alias("_o"))
    low = newest_first.agg(F.min("_o").alias("_low")).withColumn("_k", F.lit(1))
    shifted = newest_first.withColumn("_k", F.lit(1)).join(F.broadcast(low), "_k")
    numbered = dense_index(shifted.select((F.col("_o") - F.col("_low")).alias("_o")), [], "_o", "_n")
    batch = F.floor((F.col("_n") - 1) / size) + 1
    return numbered.groupBy(batch.alias("batch")).agg(F.count("*").alias("value")).select(
        F.concat(F.lit("Batch "), F.col("batch").cast("string")).alias("name"), "value")


def live_attacks(scored: DataFrame, n: int = 80, id_col: str = "stream_order") -> DataFrame:
    """The newest distinct attack rows: Attack level, or not benign with a risk of 60 and more."""
    label = F.lower("predicted_multiclass_label_name")
    hot = (F.col("alert_level") == "Attack") | (label == "attack") | ((label != "benign") & (F.col("risk_score") >= 60))
    fields = [c for c in scored.columns if c != id_col]
    once = scored.where(hot).groupBy(id_col).agg(F.min(F.struct(*fields)).alias("_r"))
    return once.orderBy(F.desc(id_col)).limit(n).select(id_col, "_r.*")


def by_risk(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(F.desc("risk_score"), "stream_order")
