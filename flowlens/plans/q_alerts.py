"""Registered queries: risk and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.columns import quantized
from flowlens.operators import alerts
from flowlens.plans.registry import oracle, query
from flowlens.sources.bindings import view


def scored(spark, sf_dir):
    return alerts.score(view(spark, sf_dir, "preds"))


@query("P1_severity", oracle("scored", "select stream_order, predicted_attack_severity from scored"))
def p1(spark, sf_dir):
    return alerts.add_severity(view(spark, sf_dir, "preds")).select("stream_order", "predicted_attack_severity")


@query("P2_class_probability", oracle("scored", """
select stream_order, attack_class_probability, round(disagreement_score, 6) as disagreement_score from scored"""))
def p2(spark, sf_dir):
    df = alerts.add_class_probability(view(spark, sf_dir, "preds"))
    return df.select("stream_order", "attack_class_probability", quantized("disagreement_score").alias("disagreement_score"))


@query("P3_risk_score", oracle("scored", "select stream_order, round(risk_score, 6) as risk_score from scored"))
def p3(spark, sf_dir):
    return scored(spark, sf_dir).select("stream_order", quantized("risk_score").alias("risk_score"))


@query("P4_alert_level", oracle("scored", "select stream_order, alert_level, is_alert from scored"))
def p4(spark, sf_dir):
    return scored(spark, sf_dir).select("stream_order", "alert_level", "is_alert")


@query("P5_alert_message", oracle("scored", """
select stream_order,
  case when alert_level = 'Normal' then '' else printf('SNT-%s-%08d', upper(alert_level), stream_order) end as alert_id,
  case when alert_level = 'Normal' then 'Normal traffic confidence within acceptable range.'
    else printf('%s alert for %s | risk=%.2f | binary_attack_probability=%.4f', alert_level,
      predicted_multiclass_label_name, risk_score, binary_attack_probability) end as alert_message
from scored"""))
def p5(spark, sf_dir):
    return scored(spark, sf_dir).select("stream_order", "alert_id", "alert_message")


@query("P6_recommended_action", oracle("scored", f"""
select stream_order, case alert_level when 'Attack' then
    case predicted_multiclass_label_name when 'DDoS' then '{alerts.ACTION_DDOS}'
      when 'PortScan' then '{alerts.ACTION_SCAN}' else '{alerts.ACTION_ATTACK}' end
  when 'Suspicious' then '{alerts.ACTION_SUSPICIOUS}' else '{alerts.ACTION_NORMAL}' end as recommended_action
from scored"""))
def p6(spark, sf_dir):
    return scored(spark, sf_dir).select("stream_order", "recommended_action")


@query("P7_alert_filter", oracle("scored", """
select stream_order, source_file, alert_level, round(risk_score, 6) as risk_score from scored where is_alert"""))
def p7(spark, sf_dir):
    df = alerts.alert_rows(scored(spark, sf_dir))
    return df.select("stream_order", "source_file", "alert_level", quantized("risk_score").alias("risk_score"))


@query("P7_alert_filter_max_rows", oracle("scored", """
select stream_order, alert_level from (select * from scored order by stream_order limit 2000) where is_alert"""))
def p7_max_rows(spark, sf_dir):
    return alerts.alert_rows(scored(spark, sf_dir), max_rows=2000).select("stream_order", "alert_level")


@query("P8_level_counts", oracle("scored", """
select l.alert_level, count(s.stream_order) as rows, round(avg(risk_score), 6) as mean_risk, round(max(risk_score), 6) as max_risk
from (values ('Normal'), ('Suspicious'), ('Attack')) as l(alert_level) left join scored s on s.alert_level = l.alert_level
group by l.alert_level"""))
def p8(spark, sf_dir):
    df = alerts.level_counts(scored(spark, sf_dir))
    return df.select("alert_level", "rows", quantized("mean_risk").alias("mean_risk"), quantized("max_risk").alias("max_risk"))


@query("P8_attack_counts", oracle("scored", """
select predicted_multiclass_label_name as attack_type, count(*) as count from scored where is_alert group by 1"""))
def p8_attacks(spark, sf_dir):
    return alerts.attack_counts(scored(spark, sf_dir))


@query("P8_risk_summary", oracle("scored", """
select count(*) as total_rows, count(*) filter (where is_alert) as alert_rows,
  round(avg(risk_score), 6) as average_risk_score, round(max(risk_score), 6) as max_risk_score from scored"""))
def p8_summary(spark, sf_dir):
    df = alerts.risk_summary(scored(spark, sf_dir))
    return df.select("total_rows", "alert_rows", F.round("average_risk_score", 6).alias("average_risk_score"),
                     F.round("max_risk_score", 6).alias("max_risk_score"))
