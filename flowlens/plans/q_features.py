"""Registered queries: row-level and window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.columns import finite_frame, quantized, safe_divide
from flowlens.operators import features
from flowlens.operators.ordering import running_sums
from flowlens.plans.registry import define, oracle, query
from flowlens.sources.bindings import view


def div(n: str, d: str) -> str:
    return f"case when abs({d}) > 1e-9 then ({n}) / cast(({d}) as double) else 0e0 end"


STAT_SQL = {
    "total_packets": "total_packets",
    "total_bytes": "total_bytes",
    "bytes_per_packet": div("total_bytes", "total_packets"),
    "fwd_bwd_packet_ratio": div("total_fwd_packets", "total_backward_packets"),
    "fwd_bwd_byte_ratio": div("total_length_of_fwd_packets", "total_length_of_bwd_packets"),
    "packet_length_range": "max_packet_length - min_packet_length",
    "flow_iat_cv": div("flow_iat_std", "flow_iat_mean"),
    "packet_length_cv": div("packet_length_std", "packet_length_mean"),
    "header_payload_ratio": div("fwd_header_length + bwd_header_length", "total_bytes"),
    "forward_payload_efficiency": div("act_data_pkt_fwd", "total_fwd_packets"),
    "idle_active_ratio": div("idle_mean", "active_mean"),
    "burstiness_score": div("active_mean - idle_mean", "active_mean + idle_mean"),
    "segment_size_asymmetry": div("abs(avg_fwd_segment_size - avg_bwd_segment_size)",
                                  "avg_fwd_segment_size + avg_bwd_segment_size"),
    "ack_push_ratio": div("ack_flag_count", "psh_flag_count + 1"),
    "payload_density": div("total_bytes", "flow_duration"),
}
FLAG_SQL = {
    "syn_ratio": div("syn_flag_count", "total_packets"),
    "connection_failure_score": div("rst_flag_count + fin_flag_count", "total_packets"),
    "connection_reset_ratio": div("rst_flag_count", "total_packets"),
}


def frame(w: int) -> str:
    return f"over (partition by source_file order by row_id rows between {w - 1} preceding and current row)"


ROLL_SQL = {}
for _w in (5, 20):
    ROLL_SQL |= {
        f"rolling_flow_bytes_mean_w{_w}": f"avg(flow_bytes_per_s) {frame(_w)}",
        f"rolling_flow_packets_mean_w{_w}": f"avg(flow_packets_per_s) {frame(_w)}",
        f"rolling_short_flow_fraction_w{_w}": f"avg(case when flow_duration <= 1000000 then 1e0 else 0e0 end) {frame(_w)}",
        f"rolling_syn_sum_w{_w}": f"cast(sum(syn_flag_count) {frame(_w)} as double)",
        f"rolling_rst_sum_w{_w}": f"cast(sum(rst_flag_count) {frame(_w)} as double)",
    }
ROLL_SQL["rolling_unique_destination_ports_w20"] = f"cast(count(distinct destination_port) {frame(20)} as double)"

define("totals", """select *, total_fwd_packets + total_backward_packets as total_packets,
  total_length_of_fwd_packets + total_length_of_bwd_packets as total_bytes from flows""", "flows")
define("rolled", "select *, " + ", ".join(f"{v} as {k}" for k, v in ROLL_SQL.items()) + " from totals", "totals")
define("scanned", """select *, rolling_syn_sum_w20 / 20e0 as rolling_syn_ratio_w20,
  rolling_rst_sum_w20 / 20e0 as rolling_connection_failure_ratio_w20,
  rolling_unique_destination_ports_w20 * rolling_short_flow_fraction_w20 * (rolling_syn_sum_w20 / 20e0 + 1e0)
    as port_scan_pattern_score_w20 from rolled""", "rolled")
define("engineered", "select *, " + ", ".join(
    f"{v} as {k}" for k, v in {**STAT_SQL, **FLAG_SQL}.items() if k not in ("total_packets", "total_bytes")
) + " from scanned", "scanned")


def rounded(names) -> str:
    return ", ".join(f"round(cast({n} as double), 6) as {n}" for n in names)


def rounded_cols(names):
    return [quantized(F.col(n).cast("double")).alias(n) for n in names]


def flows(spark, sf_dir):
    return view(spark, sf_dir, "flows")


@query("H1_safe_divide", oracle("flows", f"""
select row_id, round({div('flow_packets_per_s', 'total_backward_packets')}, 6) as quotient,
  round({div('idle_mean', '(total_backward_packets * 1e-10)')}, 6) as tiny_denominator from flows"""))
def h1(spark, sf_dir):
    return flows(spark, sf_dir).select(
        "row_id",
        quantized(safe_divide("flow_packets_per_s", "total_backward_packets")).alias("quotient"),
        quantized(safe_divide("idle_mean", F.col("total_backward_packets") * F.lit(1e-10))).alias("tiny_denominator"),
    )


@query("H2_statistical_features", oracle("totals", "select row_id, " + ", ".join(
    f"round(cast({v} as double), 6) as {k}" for k, v in STAT_SQL.items()) + " from totals"))
def h2(spark, sf_dir):
    return features.add_statistics(flows(spark, sf_dir)).select("row_id", *rounded_cols(features.STATISTICAL))


@query("H3_flag_ratios", oracle("totals", "select row_id, " + ", ".join(
    f"round({v}, 6) as {k}" for k, v in FLAG_SQL.items()) + " from totals"))
def h3(spark, sf_dir):
    df = features.add_flag_ratios(features.add_totals(flows(spark, sf_dir)))
    return df.select("row_id", *rounded_cols(features.FLAG_RATIOS))


@query("H4_short_flow_flag", oracle("flows", """
select row_id, case when flow_duration <= 1000000 then 1e0 else 0e0 end as short_flow from flows"""))
def h4(spark, sf_dir):
    return flows(spark, sf_dir).select("row_id", features.short_flow().alias("short_flow"))


@query("H5_finite_sweep", oracle("flows_raw", """
select row_id, coalesce(case when isinf(v) or isnan(v) then 0e0 else v end, 0e0) as flow_bytes_per_s,
  coalesce(w, 0e0) as idle_mean
from (select row_id, try_cast(flow_bytes_per_s as double) as v, try_cast(idle_mean as double) as w from flows_raw)"""))
def h5(spark, sf_dir):
    raw = view(spark, sf_dir, "flows_raw").select(
        "row_id", F.col("flow_bytes_per_s").try_cast("double").alias("flow_bytes_per_s"),
        F.col("idle_mean").try_cast("double").alias("idle_mean"))
    return finite_frame(raw, 0.0)


def _rolling(name: str, columns: list[str]):
    @query(name, oracle("scanned", f"select row_id, source_file, {rounded(columns)} from scanned"))
    def run(spark, sf_dir):
        rolled = features.add_rolling(flows(spark, sf_dir))
        return rolled.select("row_id", "source_file", *rounded_cols(columns))


_rolling("I1_rolling_mean", [f"rolling_flow_{c}_mean_w{w}" for w in (5, 20) for c in ("bytes", "packets")])
_rolling("I2_rolling_short_fraction", [f"rolling_short_flow_fraction_w{w}" for w in (5, 20)])
_rolling("I3_rolling_sum", [f"rolling_{c}_sum_w{w}" for w in (5, 20) for c in ("syn", "rst")])
_rolling("I4_rolling_distinct", ["rolling_unique_destination_ports_w20"])
_rolling("I5_rolling_flag_ratio", ["rolling_syn_ratio_w20", "rolling_connection_failure_ratio_w20"])
_rolling("I6_port_scan_score", ["port_scan_pattern_score_w20"])


@query("I7_halo_partitioned_window", oracle("scanned", f"""
select row_id, source_file, {rounded(features.rolling_names())} from scanned"""))
def i7(spark, sf_dir):
    """Blocks far shorter than the sources, so that most frames start in a neighbouring block."""
    rolled = features.add_rolling(flows(spark, sf_dir), block_rows=97)
    return rolled.select("row_id", "source_file", *rounded_cols(features.rolling_names()))


SEQ = ("flow_bytes_per_s", "flow_packets_per_s", "destination_port")


def sequence_sql(stride: int) -> str:
    return oracle("flows", f"""
with s as (select row_id, source_file, row_number() over (partition by source_file order by row_id) as rn,
    list(struct_pack(a := cast(flow_bytes_per_s as double), b := cast(flow_packets_per_s as double),
      c := cast(destination_port as double))) over (partition by source_file order by row_id
      rows between 11 preceding and current row) as seq from flows)
select row_id, source_file, cast(len(seq) as int) as steps, round(seq[1].a, 6) as first_bytes, round(seq[12].a, 6) as last_bytes,
  round(list_sum(list_transform(seq, lambda x: x.b)), 6) as packet_sum,
  round(list_sum(list_transform(seq, lambda x: x.c)), 6) as port_sum
from s where rn >= 12 and (rn - 12) % {stride} = 0""")


def _sequences(name: str, stride: int):
    @query(name, sequence_sql(stride))
    def run(spark, sf_dir):
        seq = features.sequences(flows(spark, sf_dir), SEQ, stride=stride)
        total = lambda i: F.aggregate("sequence", F.lit(0.0), lambda acc, x: acc + x[i])
        return seq.select(
            "row_id", "source_file", F.size("sequence").alias("steps"),
            quantized(F.col("sequence")[0][0]).alias("first_bytes"),
            quantized(F.col("sequence")[11][0]).alias("last_bytes"),
            quantized(total(1)).alias("packet_sum"), quantized(total(2)).alias("port_sum"),
        )


_sequences("I8_sequences_scoring", 1)
_sequences("I8_sequences_training", 3)


@query("I9_running_count_per_key", oracle("scored", """
select stream_order, source_file, cast(sum(case when alert_level <> 'Normal' then 1 else 0 end)
  over (partition by source_file order by stream_order rows unbounded preceding) as bigint) as repeat_offense_count
from scored"""))
def i9(spark, sf_dir):
    from flowlens.plans.q_alerts import scored

    df = scored(spark, sf_dir).select("stream_order", "source_file", "alert_level")
    hit = F.when(F.col("alert_level") != "Normal", 1).otherwise(0)
    return running_sums(df, ["source_file"], "stream_order", {"repeat_offense_count": hit}).drop("alert_level")


PICKED = ["destination_port", "flow_bytes_per_s", "burstiness_score", "rolling_unique_destination_ports_w20"]


@query("I10_selected_projection", oracle("engineered", f"""
select row_id, {rounded(PICKED)}, label, source_file, label_binary, label_multiclass from engineered"""))
def i10(spark, sf_dir):
    df = features.select_features(features.engineer(flows(spark, sf_dir)), PICKED)
    return df.select("row_id", *rounded_cols(PICKED), "label", "source_file", "label_binary", "label_multiclass")


@query("HI_engineered_table", oracle("engineered", f"""
select row_id, source_file, {rounded([*features.STATISTICAL, *features.FLAG_RATIOS, *features.rolling_names()])} from engineered"""))
def engineered(spark, sf_dir):
    names = [*features.STATISTICAL, *features.FLAG_RATIOS, *features.rolling_names()]
    return features.engineer(flows(spark, sf_dir)).select("row_id", "source_file", *rounded_cols(names))
