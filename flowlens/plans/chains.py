"""The operators put together as a user runs them: files to features, predictions to alerts and responses."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.operators import alerts, cleaning, drift, features, labels, respond, schema, selection, splits, views
from flowlens.session import cut_lineage
from flowlens.sources import csv_files


class Prepared(NamedTuple):
    ingested: DataFrame
    cleaned: DataFrame
    labelled: DataFrame
    engineered: DataFrame


def prepare(spark: SparkSession, folder: str, out: str, rules: cleaning.CleaningRules = cleaning.CleaningRules()) -> Prepared:
    """Raw files to engineered features.

    A table is written after each stage whose result is read more than once: row ids are then fixed, and the
    statistics of the next stage do not repeat the work of the last one.
    """
    def stored(name: str, df: DataFrame) -> DataFrame:
        csv_files.write_table(df, f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    ingested = stored("ingested", schema.infer_numbers(csv_files.read_files(spark, folder)))
    cleaned = stored("cleaned", cleaning.clean(ingested, rules))
    cleaning.validate(cleaned, rules)
    labelled = stored("labelled", labels.label_rows(cleaned))
    return Prepared(ingested, cleaned, labelled, stored("engineered", features.engineer(labelled)))


def choose_features(
    train: DataFrame, candidates: Sequence[str], target: str = "label_multiclass", row_id: str = "row_id",
    elimination_sample: int = 50_000, information: int = selection.TOP_INFORMATION,
    keep: int = selection.KEEP_FEATURES,
) -> list[str]:
    """Correlation filter and mutual information over all rows, then elimination with fits on a stratified sample."""
    rows = train.select(row_id, target, *candidates)
    left = selection.kept_features(candidates, selection.correlation_filter(selection.correlations(rows, candidates)))
    left = selection.top_information(selection.neighbour_information(rows, left, target), left, information)
    fewer = splits.stratified_sample(rows, target, row_id, elimination_sample)
    kinds = sorted(r[0] for r in fewer.select(target).distinct().collect())
    place = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col(target)) - 1
    ranking = selection.eliminate(fewer.withColumn("_class", place), left, "_class", keep)
    chosen = {r["feature"] for r in ranking.where("selected").collect()}
    return [f for f in left if f in chosen]


def score_and_alert(preds: DataFrame, rules: alerts.RiskRules = alerts.RiskRules()) -> dict[str, DataFrame]:
    scored = alerts.score(preds, rules)
    return {"scored": scored, "alerts": alerts.alert_rows(scored), "levels": alerts.level_counts(scored),
            "attacks": alerts.attack_counts(scored), "summary": alerts.risk_summary(scored)}


def respond_to(
    scored: DataFrame, flows: DataFrame, anomalies: DataFrame, reference: DataFrame, drift_features: Sequence[str],
    rules: respond.ResponseRules = respond.ResponseRules(),
) -> dict[str, DataFrame]:
    """Classified rows, zero-day rows, blocks, review queue, drift and retraining recommendation."""
    # read by every output below, so computed once
    classified = cut_lineage(respond.respond(respond.align(scored, flows, anomalies), rules))
    queue = respond.review_queue(classified, rules.queue_size)
    shifted = drift.drift(drift.feature_stats(reference, drift_features, "reference"),
                          drift.feature_stats(flows, drift_features, "stream"))
    k = F.lit(1).alias("_k")
    counts = classified.agg(
        F.count_if("is_zero_day").alias("zero_day_candidate_rows"),
        F.least(F.count_if(F.col("review_reasons") != ""), F.lit(rules.queue_size).cast("bigint")).alias("continuous_learning_queue_rows"),
    ).select("*", k)
    drifted = shifted.agg(F.count_if("drifted").alias("drifted_feature_count")).select("*", k)
    return {
        "classified": classified, "zero_day": classified.where("is_zero_day"), "blocks": classified.where("auto_block"),
        "queue": queue, "drift": drift.top_drift(shifted), "counts": respond.response_counts(classified),
        "manifest": drift.retraining(counts.join(F.broadcast(drifted), "_k").drop("_k")),
    }


def dashboard(scored: DataFrame, latencies: DataFrame, recent_rows: int = 50, top_labels: int = 8) -> dict[str, DataFrame]:
    """Every table the operations view shows, each a query of its own over the scored table."""
    found = alerts.alert_rows(scored)
    flagged = scored.withColumn("_flag", (F.col("binary_attack_probability") >= 0.5).cast("int"))
    return {
        "overview": views.overview(scored, latencies), "levels": views.counts_by_level(scored),
        "attacks": views.attack_distribution(found), "recent": views.recent(scored, recent_rows),
        "recent_alerts": views.recent(found, recent_rows),
        "confusion": views.binary_confusion(flagged, "true_binary_label", "_flag"),
        "classes": views.compact_confusion(scored, "true_multiclass_label_name", "predicted_multiclass_label_name",
                                           "stream_order", top_labels),
        "timeline": views.alert_timeline(found, "event_time_utc"), "latency": views.latency_summary(latencies),
    }
