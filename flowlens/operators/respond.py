"""Response decisions: novelty, zero-day candidates, threat families, blocking, review queue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.functions import vocab
from flowlens.functions.columns import require_columns
from flowlens.operators.ordering import BLOCK_ROWS, running_sums

DETECTORS = ("p1", "p2", "p3", "p4")
CONTEXT = ("destination_port", "flow_bytes_per_s", "total_fwd_packets", "rolling_unique_destination_ports_w20",
           "forward_payload_efficiency", "burstiness_score")


@dataclass(frozen=True)
class ResponseRules:
    """Thresholds; the defaults are the published configuration."""

    min_risk: float = 40.0
    min_mean: float = 0.70
    min_max: float = 0.85
    min_disagreement: float = 0.15
    max_confidence: float = 0.75
    binary_margin: float = 0.1
    low_confidence: float = 0.6
    divergence: float = 0.05
    block_attack: float = 85.0
    block_zero_day: float = 70.0
    block_hits: int = 2
    block_ttl_minutes: int = 60
    queue_size: int = 5000


def c(name: str) -> Column:
    return F.col(name)


def consensus(df: DataFrame, detectors=DETECTORS) -> DataFrame:
    """Mean and maximum over the detector probabilities."""
    total = sum((c(d) for d in detectors[1:]), c(detectors[0]))
    return df.withColumns({
        "mean_anomaly": total / F.lit(float(len(detectors))),
        "max_anomaly": F.greatest(*detectors),
    })


def alignment(preds: DataFrame, flows: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One row: rows that lack a partner, and partners that disagree on the source."""
    p = preds.select("original_index", c("source_file").alias("_ps"), F.lit(1).alias("_p"))
    f = flows.select(c("row_id").alias("original_index"), c("source_file").alias("_fs"), F.lit(1).alias("_f"))
    a = anomalies.select("original_index", F.lit(1).alias("_a"))
    joined = p.join(f, "original_index", "full_outer").join(a, "original_index", "full_outer")
    return joined.agg(
        F.count_if(c("_p").isNotNull() & c("_f").isNotNull() & c("_a").isNotNull()).alias("matched"),
        F.count_if(c("_p").isNull()).alias("missing_predictions"),
        F.count_if(c("_f").isNull()).alias("missing_features"),
        F.count_if(c("_a").isNull()).alias("missing_anomalies"),
        F.count_if(c("_ps") != c("_fs")).alias("source_mismatches"),
    )


def align(preds: DataFrame, flows: DataFrame, anomalies: DataFrame, check: bool = True) -> DataFrame:
    """Predictions with the features and detector scores of the same row; fails when rows do not pair up."""
    context = [name for name in CONTEXT if name in flows.columns]
    if check:
        report = alignment(preds, flows, anomalies).first().asDict()
        wrong = {k: v for k, v in report.items() if k != "matched" and v}
        if wrong:
            raise ValueError(f"predictions, features and detector scores are misaligned: {wrong}")
    features = flows.select(c("row_id").alias("original_index"), *context)
    return preds.join(features, "original_index").join(anomalies, "original_index")


def add_novelty(df: DataFrame) -> DataFrame:
    """Needs the detector consensus."""
    gap = c("mean_anomaly") - c("binary_attack_probability")
    out = df.withColumn("anomaly_disagreement", F.greatest(gap, F.lit(0.0)))
    raw = F.lit(100.0) * (
        F.lit(0.45) * c("mean_anomaly") + F.lit(0.20) * c("max_anomaly")
        + F.lit(0.20) * F.least("anomaly_disagreement", F.lit(1.0))
        + F.lit(0.15) * (F.lit(1.0) - c("multiclass_confidence"))
    )
    return out.withColumn("novelty_score", F.greatest(F.least(raw, F.lit(100.0)), F.lit(0.0)))


def add_zero_day(df: DataFrame, rules: ResponseRules = ResponseRules()) -> DataFrame:
    benign = c("predicted_multiclass_label_name") == vocab.BENIGN
    return df.withColumn(
        "is_zero_day",
        (c("risk_score") >= rules.min_risk) & (c("mean_anomaly") >= rules.min_mean)
        & (c("max_anomaly") >= rules.min_max) & (c("anomaly_disagreement") >= rules.min_disagreement)
        & (benign | (c("multiclass_confidence") <= rules.max_confidence)),
    )


def codes(*named: tuple[Column, str]) -> Column:
    """Array of the names whose condition holds."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in named]))


def joined_codes(array: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(array)), "|")


def add_reasons(df: DataFrame, rules: ResponseRules = ResponseRules()) -> DataFrame:
    """Reason codes of zero-day candidates and of rows to review."""
    candidate = codes(
        (c("mean_anomaly") >= rules.min_mean, "high_anomaly_consensus"),
        (c("max_anomaly") >= rules.min_max, "detector_peak_alarm"),
        (c("anomaly_disagreement") >= rules.min_disagreement, "anomaly_ensemble_disagreement"),
        (c("predicted_multiclass_label_name") == vocab.BENIGN, "benign_prediction_conflict"),
        (c("multiclass_confidence") <= rules.max_confidence, "low_multiclass_confidence"),
    )
    boundary = codes(
        (F.abs(c("binary_attack_probability") - 0.5) <= rules.binary_margin, "binary_decision_boundary"),
        (c("multiclass_confidence") <= rules.low_confidence, "multiclass_decision_boundary"),
        (c("mean_anomaly") - c("binary_attack_probability") >= rules.divergence, "classifier_anomaly_divergence"),
    )
    mine = F.when(c("is_zero_day"), candidate).otherwise(F.array().cast("array<string>"))
    return df.withColumn("zero_day_reasons", joined_codes(mine)).withColumn(
        "review_reasons", joined_codes(F.concat(mine, boundary))
    )


def _described(values: tuple) -> Column:
    return F.struct(*[F.lit(v).alias(n) for n, v in zip(vocab.DESCRIPTOR_FIELDS, values)])


def novel_descriptor() -> Column:
    """Family of a candidate predicted benign, from its behaviour; a missing feature counts as zero."""
    ports, rate, packets, efficiency, burst = (
        F.coalesce(c(n), F.lit(0)) for n in (
            "rolling_unique_destination_ports_w20", "flow_bytes_per_s", "total_fwd_packets",
            "forward_payload_efficiency", "burstiness_score"))
    return (
        F.when(ports >= 5, _described(vocab.NOVEL_RECON))
        .when((rate >= 100000) | (packets >= 200) | (burst >= 2.5), _described(vocab.NOVEL_FLOOD))
        .when(efficiency >= 20, _described(vocab.NOVEL_EXPLOIT))
        .otherwise(_described(vocab.NOVEL_OTHER))
    )


def add_descriptor(df: DataFrame) -> DataFrame:
    """Family, tactic, severity tier, playbook and scope of the predicted label."""
    dim = vocab.descriptor_dim(df.sparkSession)
    known = F.struct(*vocab.DESCRIPTOR_FIELDS)
    dim = dim.select("predicted_multiclass_label_name", known.alias("_known"))
    joined = df.join(F.broadcast(dim), "predicted_multiclass_label_name", "left")
    out = joined.withColumn("_d", F.coalesce("_known", _described(vocab.DEFAULT_DESCRIPTOR)))
    return out.select(*df.columns, "_d.*")


def add_operational_descriptor(df: DataFrame) -> DataFrame:
    """As above, with the behavioural family for zero-day candidates predicted benign."""
    out = add_descriptor(df)
    unknown = c("is_zero_day") & (c("predicted_multiclass_label_name") == vocab.BENIGN)
    chosen = F.when(unknown, novel_descriptor()).otherwise(F.struct(*vocab.DESCRIPTOR_FIELDS))
    return out.withColumn("_d", chosen).select(*df.columns, "_d.*")


def add_operational_label(df: DataFrame) -> DataFrame:
    label, conf = c("predicted_multiclass_label_name"), c("multiclass_confidence")
    return df.withColumns({
        "operational_label": F.when(~c("is_zero_day"), label).when(label == vocab.BENIGN, "UNKNOWN-NOVELTY")
        .otherwise(F.concat(F.lit("Novel Variant - "), label)),
        "confidence_tier": F.when(conf >= 0.85, "High").when(conf >= 0.65, "Medium").otherwise("Low"),
    })


def add_block_target(df: DataFrame) -> DataFrame:
    """Key under which repeated offences are counted. A flow signature holds the row index, so it never repeats."""
    port = c("destination_port").cast("bigint").cast("string")
    signature = F.concat_ws(
        ":", F.lit("flow_signature"), c("source_file"),
        F.when(port.isNull(), "unknown_port").otherwise(F.concat(F.lit("port:"), port)),
        c("operational_label"), c("original_index").cast("string"),
    )
    return df.withColumn(
        "block_target",
        F.when((c("response_scope") == "destination_port") & port.isNotNull(), F.concat(F.lit("destination_port:"), port))
        .when(c("response_scope") == "source_file", F.concat(F.lit("source_file:"), c("source_file")))
        .otherwise(signature),
    )


def add_repeat_count(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Offences seen so far on the same target, this row included."""
    offence = F.when((c("alert_level") != "Normal") | c("is_zero_day"), 1).otherwise(0)
    return running_sums(df, ["block_target"], "stream_order", {"repeat_offense_count": offence}, block_rows)


# Action names and reasons.
ACTIONS = {
    (True, "destination_port"): "SIMULATED_DESTINATION_PORT_QUARANTINE",
    (True, "source_file"): "SIMULATED_SOURCE_CONTAINMENT",
    (True, ""): "SIMULATED_FLOW_SIGNATURE_QUARANTINE",
    (False, "destination_port"): "SIMULATED_PORT_BLOCK",
    (False, "source_file"): "SIMULATED_SOURCE_RATE_LIMIT",
    (False, ""): "SIMULATED_FLOW_SIGNATURE_BLOCK",
}
NO_ACTION = "MONITOR_ONLY"
REASON_ZERO_DAY = "Zero-day novelty score exceeded the containment threshold with repeated offenses."
REASON_ATTACK = "High-risk repeated attack pattern triggered simulated containment."
REASON_NONE = "No automatic containment trigger satisfied."
FEEDBACK_ZERO_DAY = "Prioritize analyst triage, label the sample, and schedule it for the next supervised retraining window."
FEEDBACK_REVIEW = "Review the boundary-case sample and feed the labeled result into the active-learning buffer."
FEEDBACK_NONE = "No analyst review required."


def add_block_decision(df: DataFrame, rules: ResponseRules = ResponseRules()) -> DataFrame:
    hits = c("repeat_offense_count") >= rules.block_hits
    zero_day = c("is_zero_day") & (c("novelty_score") >= rules.block_zero_day) & hits
    attack = (c("alert_level") == "Attack") & (c("risk_score") >= rules.block_attack) & hits

    def action(kind: bool) -> Column:
        scope = c("response_scope")
        return (F.when(scope == "destination_port", ACTIONS[kind, "destination_port"])
                .when(scope == "source_file", ACTIONS[kind, "source_file"]).otherwise(ACTIONS[kind, ""]))

    return df.withColumns({
        "auto_block": zero_day | attack,
        "auto_block_action": F.when(zero_day, action(True)).when(attack, action(False)).otherwise(NO_ACTION),
        "auto_block_reason": F.when(zero_day, REASON_ZERO_DAY).when(attack, REASON_ATTACK).otherwise(REASON_NONE),
        "auto_block_ttl_minutes": F.when(zero_day | attack, rules.block_ttl_minutes).otherwise(0),
    })


def add_priority(df: DataFrame) -> DataFrame:
    boundary = F.lit(1.0) - F.least(F.abs(c("binary_attack_probability") - 0.5) / F.lit(0.5), F.lit(1.0))
    raw = (
        F.lit(0.50) * (c("novelty_score") / F.lit(100.0)) + F.lit(0.20) * (c("risk_score") / F.lit(100.0))
        + F.lit(0.20) * (F.lit(1.0) - c("multiclass_confidence")) + F.lit(0.10) * boundary
    )
    raised = F.when(c("is_zero_day"), raw + F.lit(0.10)).otherwise(raw)
    return df.withColumn("feedback_priority", F.least(raised * F.lit(100.0), F.lit(100.0)))


def add_feedback(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "suggested_feedback_action",
        F.when(c("review_reasons") == "", FEEDBACK_NONE).when(c("is_zero_day"), FEEDBACK_ZERO_DAY)
        .otherwise(FEEDBACK_REVIEW),
    )


def respond(aligned: DataFrame, rules: ResponseRules = ResponseRules(), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Scored predictions with context and detector probabilities to classified response rows.

    The one shuffle, by block target and block of rows, comes before the long texts are added.
    """
    require_columns(aligned, ("stream_order", "original_index", "source_file", "risk_score", "alert_level",
                              "binary_attack_probability", "multiclass_confidence", *DETECTORS), "the aligned table")
    out = add_zero_day(add_novelty(consensus(aligned)), rules)
    out = add_operational_label(out)
    scoped = add_operational_descriptor(out).select(*out.columns, "response_scope")
    counted = add_repeat_count(add_block_target(scoped), block_rows)
    full = add_operational_descriptor(counted.drop("response_scope"))
    return add_feedback(add_priority(add_block_decision(add_reasons(full, rules), rules)))


def review_queue(classified: DataFrame, size: int = ResponseRules.queue_size) -> DataFrame:
    """Rows worth a review, highest priority first; equal priority: the latest first."""
    return (
        classified.where(c("review_reasons") != "")
        .orderBy(F.desc("feedback_priority"), F.desc("stream_order")).limit(size)
    )


def response_counts(classified: DataFrame) -> DataFrame:
    """Long table (kind, name, count): families, zero-day families, block actions, benign and attack rows."""
    label = F.when(c("predicted_multiclass_label_name") == vocab.BENIGN, "benign").otherwise("known_attack")
    kinds = F.array_compact(F.array(
        F.struct(F.lit("family").alias("kind"), c("threat_family").alias("name")),
        F.when(c("is_zero_day"), F.struct(F.lit("zero_day_family").alias("kind"), c("threat_family").alias("name"))),
        F.when(c("auto_block"), F.struct(F.lit("block_action").alias("kind"), c("auto_block_action").alias("name"))),
        F.struct(F.lit("rows").alias("kind"), label.alias("name")),
    ))
    return classified.select(F.inline(kinds)).groupBy("kind", "name").agg(F.count("*").alias("count"))


def response_summary(classified: DataFrame) -> DataFrame:
    return classified.agg(
        F.count("*").alias("total_rows"), F.count_if("is_zero_day").alias("zero_day_rows"),
        F.count_if("auto_block").alias("auto_block_rows"), F.avg("novelty_score").alias("average_novelty_score"),
    )
