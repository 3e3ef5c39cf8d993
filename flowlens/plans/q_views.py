"""Registered queries: serving views."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from flowlens.functions.columns import quantized
from flowlens.operators import alerts, views
from flowlens.operators.ordering import exact_quantiles
from flowlens.operators.pages import PageStore
from flowlens.operators.registry import exists
from flowlens.plans.q_alerts import scored
from flowlens.plans.registry import define, oracle, query
from flowlens.session import shared_dir
from flowlens.sources.bindings import table, view

define("latencies", """select event_id // 256 as batch_id, count(*) as rows, cast(max(value) as double) as latency_ms
  from events group by 1""")
define("candidates", """select event_type as benchmark, 64 * (1 + user_id % 5) as candidate_value,
  quantile_cont(value, 95e-2) as p95_ms, count(*) * 1e3 / cast(sum(round(value * 100)) / 100e0 as double) as rows_per_second
  from events group by 1, 2""")


def latencies(spark, sf_dir):
    """A run log made from the events: one run per 256 events."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.expr("event_id div 256").alias("batch_id")).agg(
        F.count("*").alias("rows"), F.max("value").alias("latency_ms"))


def candidates(spark, sf_dir):
    keys = ["benchmark", "candidate_value"]
    runs = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("benchmark"), (F.lit(64) * (1 + F.col("user_id") % 5)).alias("candidate_value"), "value")
    speed = runs.groupBy(*keys).agg(
        (F.count("*") * 1e3 / (F.sum(F.round(F.col("value") * 100)) / F.lit(100.0))).alias("rows_per_second"))
    return speed.join(exact_quantiles(runs, "value", (0.95,), keys).withColumnRenamed("q0", "p95_ms"), keys)


RECENT = ("stream_order", "source_file", "predicted_multiclass_label_name", "risk_score", "alert_level")


def recent_cols():
    return [quantized(c).alias(c) if c == "risk_score" else F.col(c) for c in RECENT]


RECENT_SQL = "stream_order, source_file, predicted_multiclass_label_name, round(risk_score, 6) as risk_score, alert_level"


@query("Q16_recent_predictions", oracle("scored", f"select {RECENT_SQL} from scored order by stream_order desc limit 50"))
def q16(spark, sf_dir):
    return views.recent(scored(spark, sf_dir), 50).select(*recent_cols())


@query("Q16_recent_alerts", oracle("scored", f"""
select {RECENT_SQL} from scored where is_alert order by stream_order desc limit 50"""))
def q16_alerts(spark, sf_dir):
    return views.recent(alerts.alert_rows(scored(spark, sf_dir)), 50).select(*recent_cols())


@query("Q17_level_counts", oracle("scored", "select alert_level, count(*) as count from scored group by 1"))
def q17(spark, sf_dir):
    return views.counts_by_level(scored(spark, sf_dir))


@query("Q17_attack_distribution", oracle("scored", """
select predicted_multiclass_label_name as attack_type, count(*) as count from scored where is_alert group by 1"""))
def q17_attacks(spark, sf_dir):
    return views.attack_distribution(alerts.alert_rows(scored(spark, sf_dir)))


def binary(spark, sf_dir):
    return view(spark, sf_dir, "preds").withColumn(
        "predicted_binary_label", (F.col("binary_attack_probability") >= 0.5).cast("int"))


BINARY_SQL = """
select case t when 0 then 'Actual BENIGN' else 'Actual ATTACK' end as actual,
  count(*) filter (where p = 0) as predicted_benign, count(*) filter (where p = 1) as predicted_attack
from (select true_binary_label as t, case when binary_attack_probability >= 5e-1 then 1 else 0 end as p from preds) group by t"""


@query("Q18_binary_confusion", oracle("preds", BINARY_SQL))
def q18(spark, sf_dir):
    return views.binary_confusion(binary(spark, sf_dir), "true_binary_label", "predicted_binary_label")


@query("Q18_confusion_payload", oracle("preds", f"""
select 'Actual BENIGN,Actual ATTACK' as "index", 'Predicted BENIGN,Predicted ATTACK' as columns,
  string_agg(predicted_benign || ',' || predicted_attack, ';' order by actual desc) as data from ({BINARY_SQL})"""))
def q18_payload(spark, sf_dir):
    payload = views.confusion_payload(q18(spark, sf_dir))
    return payload.select(
        F.array_join("index", ",").alias("index"), F.array_join("columns", ",").alias("columns"),
        F.array_join(F.transform("data", lambda r: F.array_join(r.cast("array<string>"), ",")), ";").alias("data"))


def confusion_sql(keep: int) -> str:
    return oracle("preds", f"""
with totals as (select true_multiclass_label_name as label, count(*) as n, min(stream_order) as first from preds group by 1),
top as (select label from totals where label <> 'BENIGN' order by n desc, first limit {keep}),
shown as (select 'BENIGN' as label union all select label from top),
labels as (select label from shown union all select 'OTHER' where exists (select 1 from totals where label not in (select label from shown))),
pairs as (select case when true_multiclass_label_name in (select label from shown) then true_multiclass_label_name else 'OTHER' end as actual,
  case when predicted_multiclass_label_name in (select label from shown) then predicted_multiclass_label_name else 'OTHER' end as predicted
  from preds)
select a.label as actual, p.label as predicted, count(x.actual) as count from labels a cross join labels p
left join pairs x on x.actual = a.label and x.predicted = p.label group by 1, 2""")


def _confusion(name, top_k):
    @query(name, confusion_sql(top_k - 1))
    def run(spark, sf_dir):
        return views.compact_confusion(view(spark, sf_dir, "preds"), "true_multiclass_label_name",
                                       "predicted_multiclass_label_name", "stream_order", top_k)


_confusion("Q19_compact_confusion", 8)
_confusion("Q19_compact_confusion_folded", 3)


@query("Q20_alert_timeline", oracle("scored", """
select strftime(date_trunc('minute', event_time_utc), '%Y-%m-%d %H:%M') as minute,
  count(*) filter (where alert_level = 'Attack') as "Attack", count(*) filter (where alert_level = 'Suspicious') as "Suspicious"
from scored where is_alert group by 1"""))
def q20(spark, sf_dir):
    df = views.alert_timeline(alerts.alert_rows(scored(spark, sf_dir)), "event_time_utc")
    return df.withColumn("minute", F.date_format("minute", "yyyy-MM-dd HH:mm"))


@query("Q22_overview", oracle("scored latencies", """
select count(*) as rows_streamed, count(*) filter (where is_alert) as alert_rows,
  count(*) filter (where alert_level = 'Attack') as attack_alerts, round(avg(risk_score), 6) as average_risk_score,
  round(max(risk_score), 6) as max_risk_score,
  (select round(avg(latency_ms), 6) from latencies) as average_batch_latency_ms,
  (select round(sum(rows) / (sum(latency_ms) / 1e3), 4) from latencies) as throughput_rows_per_second
from scored"""))
def q22(spark, sf_dir):
    df = views.overview(scored(spark, sf_dir), latencies(spark, sf_dir))
    return df.withColumns({c: quantized(c) for c in ("average_risk_score", "max_risk_score", "average_batch_latency_ms")}
                          ).withColumn("throughput_rows_per_second", quantized("throughput_rows_per_second", 4))


PAGE_SQL = "where alert_level = 'Attack' and predicted_multiclass_label_name = 'DDoS' and risk_score >= 75"


@query("Q23_filtered_page", oracle("scored", f"""
select {RECENT_SQL}, (select count(*) from scored {PAGE_SQL}) > 150 as has_more
from scored {PAGE_SQL} order by stream_order limit 50 offset 100"""))
def q23(spark, sf_dir):
    df = views.page(scored(spark, sf_dir), 50, 100, "Attack", "DDoS", 75.0)
    return df.select(*recent_cols(), "has_more")


def page_store(spark, sf_dir) -> PageStore:
    """The scored table laid out for paging; written once per shared folder."""
    store = PageStore(spark, f"{shared_dir(spark)}/pages-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}")
    if not exists(spark, f"{store.path}/blocks/_SUCCESS"):
        store.write(scored(spark, sf_dir))
    return store


@query("Q23_stored_page", oracle("scored", f"""
select {RECENT_SQL}, (select count(*) from scored {PAGE_SQL}) > 150 as has_more
from scored {PAGE_SQL} order by stream_order limit 50 offset 100"""))
def q23_stored(spark, sf_dir):
    """The filtered page from the stored layout."""
    return page_store(spark, sf_dir).page(50, 100, "Attack", "DDoS", 75.0).select(*recent_cols(), "has_more")


@query("Q23_keyset_page", oracle("scored", f"""
select {RECENT_SQL}, true as has_more from scored where is_alert and stream_order > 4000 order by stream_order limit 1000"""))
def q23_keyset(spark, sf_dir):
    df = views.page(alerts.alert_rows(scored(spark, sf_dir)), 5000, after=4000)
    return df.select(*recent_cols(), "has_more")


REQUEST_FEATURES = ("destination_port", "flow_duration", "flow_bytes_per_s", "flow_packets_per_s", "total_fwd_packets",
                    "fwd_header_length", "idle_mean", "active_mean", "syn_flag_count", "psh_flag_count",
                    "packet_length_mean", "packet_length_std")


def requests(spark, sf_dir):
    """Request records made from the flows; a feature is left out where the row id is a multiple of its number."""
    flows = view(spark, sf_dir, "flows")
    pairs = [F.when(F.col("row_id") % (i + 7) != 0, F.struct(F.lit(f).alias("key"), F.col(f).cast("double").alias("value")))
             for i, f in enumerate(REQUEST_FEATURES)]
    return flows.select("row_id", "source_file", F.map_from_entries(F.array_compact(F.array(*pairs))).alias("features"))


REQUEST_SQL = "[" + ", ".join(f"case when row_id % {i + 7} = 0 then '{f}' end" for i, f in enumerate(REQUEST_FEATURES)) + "]"


@query("Q24_request_validation", oracle("flows", f"""
select row_id, cast(len(m) as int) as missing_count, array_to_string(m[1:10], ',') as missing
from (select row_id, list_filter({REQUEST_SQL}, lambda x: x is not null) as m from flows) where len(m) > 0"""))
def q24(spark, sf_dir):
    df = views.request_problems(requests(spark, sf_dir), REQUEST_FEATURES, "row_id")
    return df.withColumn("missing", F.array_join("missing", ","))


LATENCY_SQL = """select sum(rows)::bigint as total_rows, count(*) as total_calls, round(avg(latency_ms), 6) as mean_ms,
  round(quantile_cont(latency_ms, 5e-1), 6) as p50_ms, round(quantile_cont(latency_ms, 95e-2), 6) as p95_ms,
  round(quantile_cont(latency_ms, 99e-2), 6) as p99_ms, max(latency_ms) as max_ms,
  round(sum(latency_ms) / sum(rows), 6) as mean_row_ms, round(sum(rows) / (sum(latency_ms) / 1e3), 4) as rows_per_second
from latencies"""


@query("Q26_latency_summary", oracle("latencies", LATENCY_SQL))
def q26(spark, sf_dir):
    df = views.latency_summary(latencies(spark, sf_dir))
    return df.withColumns({c: quantized(c) for c in ("mean_ms", "p50_ms", "p95_ms", "p99_ms", "mean_row_ms")}
                          ).withColumn("rows_per_second", quantized("rows_per_second", 4))


def _best(name, limit):
    @query(name, oracle("candidates", f"""
select benchmark, candidate_value, round(p95_ms, 6) as p95_ms, round(rows_per_second, 4) as rows_per_second, ok as within_limit
from (select *, row_number() over (partition by benchmark order by ok desc, rows_per_second desc, p95_ms, candidate_value) as rn
  from (select *, p95_ms <= {limit} as ok from candidates)) where rn = 1"""))
    def run(spark, sf_dir):
        df = views.best_candidate(candidates(spark, sf_dir), limit)
        return df.withColumn("p95_ms", quantized("p95_ms")).withColumn("rows_per_second", quantized("rows_per_second", 4))


_best("Q27_best_candidate", 150.0)
_best("Q27_best_candidate_none_within", 1.0)


@query("Q28_confidence_buckets", oracle("preds", """
select case when multiclass_confidence >= 9e-1 then '90-100%' when multiclass_confidence >= 75e-2 then '75-90%'
  when multiclass_confidence >= 5e-1 then '50-75%' else '<50%' end as name, count(*) as value from preds group by 1"""))
def q28(spark, sf_dir):
    return views.confidence_buckets(view(spark, sf_dir, "preds"))


@query("Q29_counts_per_ten", oracle("preds", """
select 'Batch ' || ((rn - 1) // 10 + 1) as name, count(*) as value
from (select row_number() over (order by stream_order desc) as rn from preds) group by 1"""))
def q29(spark, sf_dir):
    return views.counts_per_ten(view(spark, sf_dir, "preds"))


@query("Q30_live_attacks", oracle("scored", f"""
select {RECENT_SQL} from scored
where alert_level = 'Attack' or (predicted_multiclass_label_name <> 'BENIGN' and risk_score >= 60)
order by stream_order desc limit 80"""))
def q30(spark, sf_dir):
    return views.live_attacks(scored(spark, sf_dir).select(*RECENT)).select(*recent_cols())


@query("Q31_alerts_by_risk", oracle("scored", f"select {RECENT_SQL} from scored where is_alert"))
def q31(spark, sf_dir):
    return views.by_risk(alerts.alert_rows(scored(spark, sf_dir))).select(*recent_cols())


@query("N12_streaming_summary", oracle("latencies", """
select sum(rows)::bigint as rows_streamed, count(*) as batches, round(avg(latency_ms), 6) as mean_batch_latency_ms,
  round(quantile_cont(latency_ms, 95e-2), 6) as p95_batch_latency_ms,
  round(sum(rows) / (sum(latency_ms) / 1e3), 4) as throughput_rows_per_second,
  (select strftime(max(ts), '%Y-%m-%d %H:%M:%S') from events) as end_time from latencies"""))
def n12(spark, sf_dir):
    last = table(spark, sf_dir, "events").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("end_time"))
    df = views.latency_summary(latencies(spark, sf_dir)).withColumn("_k", F.lit(1))
    both = df.join(F.broadcast(last.withColumn("_k", F.lit(1))), "_k")
    return both.select(
        F.col("total_rows").alias("rows_streamed"), F.col("total_calls").alias("batches"),
        quantized("mean_ms").alias("mean_batch_latency_ms"), quantized("p95_ms").alias("p95_batch_latency_ms"),
        quantized("rows_per_second", 4).alias("throughput_rows_per_second"), "end_time")
