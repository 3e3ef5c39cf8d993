"""Risk scores, alert levels and alert rows from prediction events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from flowlens.functions.local import local_table
from flowlens.functions import vocab
from flowlens.functions.columns import require_columns, with_fixed_text

NEEDED = ("stream_order", "event_time_utc", "binary_attack_probability",
          "predicted_multiclass_label_name", "multiclass_confidence")


@dataclass(frozen=True)
class RiskRules:
    """Thresholds and weights; the defaults are the published configuration."""

    suspicious: float = 40.0
    attack: float = 70.0
    binary_weight: float = 0.55
    severity_weight: float = 0.20
    class_weight: float = 0.15
    disagreement_weight: float = 0.10

    def __post_init__(self):
        if not 0 <= self.suspicious <= self.attack <= 100:
            raise ValueError("alert thresholds must be ordered and lie in 0..100")


def add_severity(preds: DataFrame) -> DataFrame:
    """Severity of the predicted label; labels outside the table weigh the default."""
    dim = vocab.severity_dim(preds.sparkSession)
    return (
        preds.join(F.broadcast(dim), "predicted_multiclass_label_name", "left")
        .withColumn("predicted_attack_severity", F.coalesce("severity", F.lit(vocab.DEFAULT_SEVERITY)))
        .select(*preds.columns, "predicted_attack_severity")
    )


def add_class_probability(preds: DataFrame) -> DataFrame:
    """Confidence of an attack class, and how far it is from the binary probability."""
    benign = F.col("predicted_multiclass_label_name") == vocab.BENIGN
    return preds.withColumn(
        "attack_class_probability", F.when(benign, F.lit(0.0)).otherwise(F.col("multiclass_confidence"))
    ).withColumn("disagreement_score", F.abs(F.col("binary_attack_probability") - F.col("attack_class_probability")))


def add_risk(preds: DataFrame, rules: RiskRules = RiskRules()) -> DataFrame:
    raw = F.lit(100.0) * (
        F.lit(rules.binary_weight) * F.col("binary_attack_probability")
        + F.lit(rules.severity_weight) * F.col("predicted_attack_severity")
        + F.lit(rules.class_weight) * F.col("attack_class_probability")
        + F.lit(rules.disagreement_weight) * F.col("disagreement_score")
    )
    clipped = F.when(raw < 0, 0.0).when(raw > 100, 100.0).otherwise(raw)
    return preds.withColumn("risk_score", F.when(~F.isnan(raw), clipped))


def add_level(scored: DataFrame, rules: RiskRules = RiskRules()) -> DataFrame:
    risk = F.col("risk_score")
    level = F.when(risk >= rules.attack, "Attack").when(risk >= rules.suspicious, "Suspicious").otherwise("Normal")
    return scored.withColumn("alert_level", level).withColumn("is_alert", F.col("alert_level") != "Normal")


def add_messages(scored: DataFrame) -> DataFrame:
    """Alert id and text. The two text formats and the text for normal rows."""
    normal = F.col("alert_level") == "Normal"
    number = F.col("stream_order").cast("string")
    padded = F.when(F.length(number) < 8, F.lpad(number, 8, "0")).otherwise(number)
    alert_id = F.concat(F.lit("SNT-"), F.upper("alert_level"), F.lit("-"), padded)
    message = F.concat(
        "alert_level", F.lit(" alert for "), "predicted_multiclass_label_name", F.lit(" | risk="), "_risk",
        F.lit(" | binary_attack_probability="), "_probability")
    texts = with_fixed_text(scored, _risk=("risk_score", 2), _probability=("binary_attack_probability", 4))
    return texts.withColumn("alert_id", F.when(normal, "").otherwise(alert_id)).withColumn(
        "alert_message", F.when(normal, "Normal traffic confidence within acceptable range.").otherwise(message)
    ).drop("_risk", "_probability")


# Action texts.
ACTION_DDOS = "Trigger containment workflow and rate-limit suspected sources."
ACTION_SCAN = "Escalate to perimeter monitoring and investigate scanning hosts."
ACTION_ATTACK = "Escalate to incident response and isolate the affected flow or host."
ACTION_SUSPICIOUS = "Increase monitoring, capture packet context, and validate against baseline."
ACTION_NORMAL = "Continue monitoring."


def add_action(scored: DataFrame) -> DataFrame:
    level, label = F.col("alert_level"), F.col("predicted_multiclass_label_name")
    attack = level == "Attack"
    action = (
        F.when(attack & (label == "DDoS"), ACTION_DDOS)
        .when(attack & (label == "PortScan"), ACTION_SCAN)
        .when(attack, ACTION_ATTACK)
        .when(level == "Suspicious", ACTION_SUSPICIOUS)
        .otherwise(ACTION_NORMAL)
    )
    return scored.withColumn("recommended_action", action)


def score(preds: DataFrame, rules: RiskRules = RiskRules()) -> DataFrame:
    """All of the above: one projection and one broadcast join, no shuffle. Works on streams too."""
    require_columns(preds, NEEDED, "the prediction table")
    out = add_risk(add_class_probability(add_severity(preds)), rules)
    return add_action(add_messages(add_level(out, rules)))


def alert_rows(scored: DataFrame, emit_normal: bool = False, max_rows: int | None = None) -> DataFrame:
    """Rows of the alert log; with `max_rows`, only the first rows of the input are considered."""
    rows = scored if max_rows is None else scored.orderBy("stream_order").limit(max_rows)
    return rows if emit_normal else rows.where("is_alert")


def level_counts(scored: DataFrame) -> DataFrame:
    """Rows, mean and maximum risk per level, with a row for every level."""
    spark = scored.sparkSession
    levels = local_table(spark, [(v,) for v in vocab.LEVELS], "alert_level string")
    found = scored.groupBy("alert_level").agg(
        F.count("*").alias("rows"), F.avg("risk_score").alias("mean_risk"), F.max("risk_score").alias("max_risk")
    )
    return levels.join(found, "alert_level", "left").select(
        "alert_level", F.coalesce("rows", F.lit(0)).alias("rows"), "mean_risk", "max_risk"
    )


def attack_counts(scored: DataFrame) -> DataFrame:
    """Alerts per predicted label."""
    return (
        scored.where("is_alert").groupBy(F.col("predicted_multiclass_label_name").alias("attack_type"))
        .agg(F.count("*").alias("count"))
    )


def risk_summary(scored: DataFrame) -> DataFrame:
    """One row: processed rows, alerts, mean and maximum risk."""
    return scored.agg(
        F.count("*").alias("total_rows"),
        F.count_if("is_alert").alias("alert_rows"),
        F.avg("risk_score").alias("average_risk_score"),
        F.max("risk_score").alias("max_risk_score"),
    )
