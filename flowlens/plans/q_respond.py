"""Registered queries: threat response, drift and retraining."""

from __future__ import annotations

import flowlens.plans.q_features  # noqa: F401  its SQL texts are used below
from pyspark.sql import functions as F

from flowlens.functions import vocab
from flowlens.functions.columns import quantized
from flowlens.operators import alerts, drift, features, respond, splits
from flowlens.plans.registry import DESCRIPTOR_SQL, define, oracle, query
from flowlens.sources.bindings import table, view


def described(values) -> str:
    return "struct_pack(" + ", ".join(f"{n} := '{v}'" for n, v in zip(vocab.DESCRIPTOR_FIELDS, values)) + ")"


def action_sql(kind: bool) -> str:
    a = respond.ACTIONS
    return (f"case response_scope when 'destination_port' then '{a[kind, 'destination_port']}' "
            f"when 'source_file' then '{a[kind, 'source_file']}' else '{a[kind, '']}' end")


CANDIDATE_SQL = """[case when mean_anomaly >= 70e-2 then 'high_anomaly_consensus' end,
  case when max_anomaly >= 85e-2 then 'detector_peak_alarm' end,
  case when anomaly_disagreement >= 15e-2 then 'anomaly_ensemble_disagreement' end,
  case when predicted_multiclass_label_name = 'BENIGN' then 'benign_prediction_conflict' end,
  case when multiclass_confidence <= 75e-2 then 'low_multiclass_confidence' end]"""
BOUNDARY_SQL = """[case when abs(binary_attack_probability - 5e-1) <= 1e-1 then 'binary_decision_boundary' end,
  case when multiclass_confidence <= 6e-1 then 'multiclass_decision_boundary' end,
  case when mean_anomaly - binary_attack_probability >= 5e-2 then 'classifier_anomaly_divergence' end]"""


def codes_sql(array: str) -> str:
    return f"coalesce(array_to_string(list_sort(list_distinct({array})), '|'), '')"


define("consensus", "select *, (p1 + p2 + p3 + p4) / 4e0 as mean_anomaly, greatest(p1, p2, p3, p4) as max_anomaly from anom", "anom")
define("aligned", """select s.*, a.mean_anomaly, a.max_anomaly, e.destination_port, e.flow_bytes_per_s,
    e.total_fwd_packets, e.rolling_unique_destination_ports_w20, e.forward_payload_efficiency, e.burstiness_score
  from scored s join consensus a using (original_index) join engineered e on e.row_id = s.original_index""",
       "scored", "consensus", "engineered")
define("novelty", """
select *, risk_score >= 40 and mean_anomaly >= 70e-2 and max_anomaly >= 85e-2 and anomaly_disagreement >= 15e-2
  and (predicted_multiclass_label_name = 'BENIGN' or multiclass_confidence <= 75e-2) as is_zero_day
from (select *, greatest(0e0, least(100e0, 100e0 * (45e-2 * mean_anomaly + 20e-2 * max_anomaly
    + 20e-2 * least(anomaly_disagreement, 1e0) + 15e-2 * (1e0 - multiclass_confidence)))) as novelty_score
  from (select *, greatest(mean_anomaly - binary_attack_probability, 0e0) as anomaly_disagreement from aligned))""", "aligned")
define("described", f"""
select n.*, d.threat_family as known_family, d.mitre_tactic as known_tactic,
  case when is_zero_day and predicted_multiclass_label_name = 'BENIGN' then
      case when rolling_unique_destination_ports_w20 >= 5 then {described(vocab.NOVEL_RECON)}
        when flow_bytes_per_s >= 100000 or total_fwd_packets >= 200 or burstiness_score >= 2.5 then {described(vocab.NOVEL_FLOOD)}
        when forward_payload_efficiency >= 20 then {described(vocab.NOVEL_EXPLOIT)}
        else {described(vocab.NOVEL_OTHER)} end
    when d.label is null then {described(vocab.DEFAULT_DESCRIPTOR)}
    else struct_pack({', '.join(f'{f} := d.{f}' for f in vocab.DESCRIPTOR_FIELDS)}) end as d,
  case when not is_zero_day then predicted_multiclass_label_name
    when predicted_multiclass_label_name = 'BENIGN' then 'UNKNOWN-NOVELTY'
    else 'Novel Variant - ' || predicted_multiclass_label_name end as operational_label,
  case when multiclass_confidence >= 85e-2 then 'High' when multiclass_confidence >= 65e-2 then 'Medium' else 'Low' end as confidence_tier
from novelty n left join {DESCRIPTOR_SQL} d on d.label = n.predicted_multiclass_label_name""", "novelty")
define("counted", """
select *, cast(sum(case when alert_level <> 'Normal' or is_zero_day then 1 else 0 end)
    over (partition by block_target order by stream_order rows unbounded preceding) as bigint) as repeat_offense_count
from (select *, case when response_scope = 'destination_port' then 'destination_port:' || destination_port
      when response_scope = 'source_file' then 'source_file:' || source_file
      else 'flow_signature:' || source_file || ':port:' || destination_port || ':' || operational_label || ':' || original_index end as block_target
  from (select * exclude (d), d.threat_family, d.mitre_tactic, d.severity_tier, d.response_playbook, d.response_scope from described))""", "described")
define("responded", f"""
select *, zero_block or attack_block as auto_block,
  case when zero_block then {action_sql(True)} when attack_block then {action_sql(False)} else 'MONITOR_ONLY' end as auto_block_action,
  case when zero_block then '{respond.REASON_ZERO_DAY}' when attack_block then '{respond.REASON_ATTACK}' else '{respond.REASON_NONE}' end as auto_block_reason,
  case when zero_block or attack_block then 60 else 0 end as auto_block_ttl_minutes,
  least((5e-1 * (novelty_score / 100e0) + 2e-1 * (risk_score / 100e0) + 2e-1 * (1e0 - multiclass_confidence)
    + 1e-1 * (1e0 - least(abs(binary_attack_probability - 5e-1) / 5e-1, 1e0)) + case when is_zero_day then 1e-1 else 0e0 end) * 100e0, 100e0) as feedback_priority,
  case when is_zero_day then {codes_sql(CANDIDATE_SQL)} else '' end as zero_day_reasons,
  case when is_zero_day then {codes_sql(f'list_concat({CANDIDATE_SQL}, {BOUNDARY_SQL})')} else {codes_sql(BOUNDARY_SQL)} end as review_reasons
from (select *, is_zero_day and novelty_score >= 70 and repeat_offense_count >= 2 as zero_block,
    alert_level = 'Attack' and risk_score >= 85 and repeat_offense_count >= 2 as attack_block from counted)""", "counted")


def aligned(spark, sf_dir):
    flows = features.engineer(view(spark, sf_dir, "flows"))
    scored = alerts.score(view(spark, sf_dir, "preds"))
    return respond.align(scored, flows, view(spark, sf_dir, "anom"), check=False)


def classified(spark, sf_dir):
    return respond.respond(aligned(spark, sf_dir))


def novelty(spark, sf_dir):
    """Without features: the novelty columns need none."""
    scored = alerts.score(view(spark, sf_dir, "preds"))
    joined = scored.join(view(spark, sf_dir, "anom"), "original_index")
    return respond.add_zero_day(respond.add_novelty(respond.consensus(joined)))


@query("L7_detector_consensus", oracle("consensus", """
select original_index, round(mean_anomaly, 6) as mean_anomaly, max_anomaly from consensus"""))
def l7(spark, sf_dir):
    df = respond.consensus(view(spark, sf_dir, "anom"))
    return df.select("original_index", quantized("mean_anomaly").alias("mean_anomaly"), "max_anomaly")


@query("Q1_alignment_report", oracle("preds flows anom", """
select count(*) as matched, 0::bigint as missing_predictions, 0::bigint as missing_features,
  0::bigint as missing_anomalies, count(*) filter (where p.source_file <> f.source_file) as source_mismatches
from preds p join flows f on f.row_id = p.original_index join anom a on a.original_index = p.original_index"""))
def q1_report(spark, sf_dir):
    return respond.alignment(*(view(spark, sf_dir, n) for n in ("preds", "flows", "anom")))


@query("Q1_aligned_rows", oracle("aligned", """
select original_index, stream_order, source_file, destination_port, round(mean_anomaly, 6) as mean_anomaly,
  round(risk_score, 6) as risk_score from aligned"""))
def q1(spark, sf_dir):
    flows, anom = view(spark, sf_dir, "flows"), view(spark, sf_dir, "anom")
    df = respond.consensus(respond.align(alerts.score(view(spark, sf_dir, "preds")), flows, anom))
    return df.select("original_index", "stream_order", "source_file", "destination_port",
                     quantized("mean_anomaly").alias("mean_anomaly"), quantized("risk_score").alias("risk_score"))


@query("Q2_novelty", oracle("novelty", """
select stream_order, round(anomaly_disagreement, 6) as anomaly_disagreement, round(novelty_score, 6) as novelty_score from novelty"""))
def q2(spark, sf_dir):
    df = novelty(spark, sf_dir)
    return df.select("stream_order", quantized("anomaly_disagreement").alias("anomaly_disagreement"),
                     quantized("novelty_score").alias("novelty_score"))


@query("Q3_zero_day", oracle("novelty", "select stream_order, is_zero_day from novelty"))
def q3(spark, sf_dir):
    return novelty(spark, sf_dir).select("stream_order", "is_zero_day")


@query("Q4_reason_codes", oracle("responded", "select stream_order, zero_day_reasons, review_reasons from responded"))
def q4(spark, sf_dir):
    return respond.add_reasons(novelty(spark, sf_dir)).select("stream_order", "zero_day_reasons", "review_reasons")


@query("Q5_threat_descriptor", oracle("preds", f"""
select stream_order, coalesce(threat_family, 'Unknown Attack') as threat_family, coalesce(mitre_tactic, 'Unknown') as mitre_tactic,
  coalesce(severity_tier, 'High') as severity_tier,
  coalesce(response_playbook, '{vocab.DEFAULT_DESCRIPTOR[3]}') as response_playbook,
  coalesce(response_scope, 'flow_signature') as response_scope
from preds left join {DESCRIPTOR_SQL} d on d.label = predicted_multiclass_label_name"""))
def q5(spark, sf_dir):
    return respond.add_descriptor(view(spark, sf_dir, "preds")).select("stream_order", *vocab.DESCRIPTOR_FIELDS)


@query("Q6_novel_family", oracle("described", """
select stream_order, d.threat_family, d.mitre_tactic, d.severity_tier, d.response_scope from described"""))
def q6(spark, sf_dir):
    df = respond.add_zero_day(respond.add_novelty(respond.consensus(aligned(spark, sf_dir))))
    return respond.add_operational_descriptor(df).select(
        "stream_order", "threat_family", "mitre_tactic", "severity_tier", "response_scope")


@query("Q7_operational_label", oracle("described", "select stream_order, operational_label, confidence_tier from described"))
def q7(spark, sf_dir):
    return respond.add_operational_label(novelty(spark, sf_dir)).select(
        "stream_order", "operational_label", "confidence_tier")


@query("Q8_block_target", oracle("counted", "select stream_order, block_target, repeat_offense_count from counted"))
def q8(spark, sf_dir):
    return classified(spark, sf_dir).select("stream_order", "block_target", "repeat_offense_count")


@query("Q9_auto_block", oracle("responded", """
select stream_order, auto_block, auto_block_action, auto_block_reason, auto_block_ttl_minutes from responded"""))
def q9(spark, sf_dir):
    return classified(spark, sf_dir).select(
        "stream_order", "auto_block", "auto_block_action", "auto_block_reason", "auto_block_ttl_minutes")


@query("Q10_review_priority", oracle("responded", "select stream_order, round(feedback_priority, 6) as feedback_priority from responded"))
def q10(spark, sf_dir):
    return respond.add_priority(novelty(spark, sf_dir)).select(
        "stream_order", quantized("feedback_priority").alias("feedback_priority"))


@query("Q11_review_queue", oracle("responded", """
select stream_order, review_reasons, round(feedback_priority, 6) as feedback_priority from responded
where review_reasons <> '' order by responded.feedback_priority desc, stream_order desc limit 5000"""))
def q11(spark, sf_dir):
    df = respond.add_priority(respond.add_reasons(novelty(spark, sf_dir)))
    return respond.review_queue(df).select(
        "stream_order", "review_reasons", quantized("feedback_priority").alias("feedback_priority"))


@query("Q12_response_counts", oracle("responded", """
select kind, name, count(*) as count from (
  select 'family' as kind, threat_family as name from responded
  union all select 'zero_day_family', threat_family from responded where is_zero_day
  union all select 'block_action', auto_block_action from responded where auto_block
  union all select 'rows', case when predicted_multiclass_label_name = 'BENIGN' then 'benign' else 'known_attack' end from responded)
group by 1, 2"""))
def q12(spark, sf_dir):
    return respond.response_counts(classified(spark, sf_dir))


@query("Q12_response_summary", oracle("responded", """
select count(*) as total_rows, count(*) filter (where is_zero_day) as zero_day_rows,
  count(*) filter (where auto_block) as auto_block_rows, round(avg(novelty_score), 4) as average_novelty_score from responded"""))
def q12_summary(spark, sf_dir):
    df = respond.response_summary(classified(spark, sf_dir))
    return df.withColumn("average_novelty_score", quantized("average_novelty_score", 4))


NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("Q13_feature_statistics", " union all ".join(
    f"select '{n}' as feature_name, round(avg({n}), 4) as feature_mean, round(stddev_pop({n}), 4) as feature_std, "
    f"count(*) as feature_rows from lineitem" for n in NUMERIC))
def q13(spark, sf_dir):
    df = drift.feature_stats(table(spark, sf_dir, "lineitem"), NUMERIC)
    return df.withColumn("feature_mean", quantized("feature_mean", 4)).withColumn("feature_std", quantized("feature_std", 4))


DRIFTING = ("destination_port", "flow_duration", "flow_bytes_per_s", "burstiness_score", "payload_density",
            "rolling_unique_destination_ports_w20")
define("split", """select *, row_number() over (partition by label_multiclass order by md5(row_id || '-42'), row_id)
  <= round(2e-1 * count(*) over (partition by label_multiclass)) as is_test from engineered""", "engineered")
DRIFT_SQL = oracle("split", f"""
with stats as ({' union all '.join(f"select '{n}' as feature_name, is_test, avg(cast({n} as double)) as m, stddev_pop(cast({n} as double)) as s from split group by is_test" for n in DRIFTING)}),
drifted as (select r.feature_name, r.m as reference_mean, r.s as reference_std, t.m as stream_mean, abs(t.m - r.m) as shift,
  abs(t.m - r.m) / greatest(r.s, 1e-6) as z_shift from stats r join stats t using (feature_name) where not r.is_test and t.is_test)
select feature_name, round(reference_mean, 6) as reference_mean, round(reference_std, 6) as reference_std,
  round(stream_mean, 6) as stream_mean, round(shift, 6) as absolute_mean_shift, round(z_shift, 6) as z_shift,
  z_shift >= 2.5 as drifted from drifted""")


def drifted(spark, sf_dir):
    marked = splits.train_test_split(view(spark, sf_dir, "flows"), "label_multiclass", "row_id")
    return drift.split_drift(features.engineer(marked), DRIFTING)


@query("Q14_feature_drift", DRIFT_SQL)
def q14(spark, sf_dir):
    df = drift.top_drift(drifted(spark, sf_dir))
    return df.select("feature_name", *[quantized(n).alias(n) for n in (
        "reference_mean", "reference_std", "stream_mean", "absolute_mean_shift", "z_shift")], "drifted")


@query("Q15_retraining_recommendation", oracle("responded", f"""
with counts as (select count(*) filter (where is_zero_day) as zero_day_candidate_rows,
    least(count(*) filter (where review_reasons <> ''), 5000) as continuous_learning_queue_rows,
    count(*) filter (where auto_block) as drifted_feature_count from responded)
select *, zero_day_candidate_rows >= 250 or continuous_learning_queue_rows >= 1500 or drifted_feature_count >= 5 as retraining_recommended,
  array_to_string([case when zero_day_candidate_rows >= 250 then 'zero_day_candidate_rows>=250' end,
    case when continuous_learning_queue_rows >= 1500 then 'continuous_learning_queue_rows>=1500' end,
    case when drifted_feature_count >= 5 then 'drifted_feature_count>=5' end], ';') as retraining_reasons,
  array_to_string([case when zero_day_candidate_rows >= 250 then '{drift.TRIGGERS[0][2]}' end,
    case when continuous_learning_queue_rows >= 1500 then '{drift.TRIGGERS[1][2]}' end,
    case when drifted_feature_count >= 5 then '{drift.TRIGGERS[2][2]}' end], ';') as recommended_actions,
  array_to_string(list_sort(list_distinct(list_concat(
    case when zero_day_candidate_rows >= 250 then [7, 8, 9, 10, 11, 12] else [] end,
    case when continuous_learning_queue_rows >= 1500 then [6, 7, 9, 10, 11, 12] else [] end,
    case when drifted_feature_count >= 5 then [4, 5, 6, 7, 8, 9, 10, 11, 12] else [] end))), ';') as recommended_phases
from counts"""))
def q15(spark, sf_dir):
    """The number of blocks stands in for drifted features: the table drifts in none."""
    df = classified(spark, sf_dir).agg(
        F.count_if("is_zero_day").alias("zero_day_candidate_rows"),
        F.least(F.count_if(F.col("review_reasons") != ""), F.lit(5000)).cast("bigint").alias("continuous_learning_queue_rows"),
        F.count_if("auto_block").alias("drifted_feature_count"),
    )
    out = drift.retraining(df)
    return out.withColumns({
        "retraining_reasons": F.array_join("retraining_reasons", ";"),
        "recommended_actions": F.array_join("recommended_actions", ";"),
        "recommended_phases": F.array_join(F.col("recommended_phases").cast("array<string>"), ";"),
    })
