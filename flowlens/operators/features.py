"""Row-level flow features and features over the last rows of a source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.functions.columns import finite_frame, require_columns, safe_divide
from flowlens.operators.ordering import BLOCK_ROWS, dense_index

WINDOWS = (5, 20)
SHORT_FLOW = 1_000_000.0
SEQUENCE_LENGTH = 12
SEQUENCE_STRIDE = 3

NEEDED = (
    "total_fwd_packets", "total_backward_packets", "total_length_of_fwd_packets", "total_length_of_bwd_packets",
    "max_packet_length", "min_packet_length", "flow_iat_std", "flow_iat_mean", "packet_length_std",
    "packet_length_mean", "fwd_header_length", "bwd_header_length", "act_data_pkt_fwd", "idle_mean", "active_mean",
    "avg_fwd_segment_size", "avg_bwd_segment_size", "ack_flag_count", "psh_flag_count", "flow_duration",
    "syn_flag_count", "rst_flag_count", "fin_flag_count", "flow_bytes_per_s", "flow_packets_per_s", "destination_port",
)

STATISTICAL = (
    "total_packets", "total_bytes", "bytes_per_packet", "fwd_bwd_packet_ratio", "fwd_bwd_byte_ratio",
    "packet_length_range", "flow_iat_cv", "packet_length_cv", "header_payload_ratio", "forward_payload_efficiency",
    "idle_active_ratio", "burstiness_score", "segment_size_asymmetry", "ack_push_ratio", "payload_density",
)
SUMS = ("total_packets", "total_bytes", "packet_length_range")
FLAG_RATIOS = ("syn_ratio", "connection_failure_score", "connection_reset_ratio")


def rolling_names(windows: Sequence[int] = WINDOWS) -> list[str]:
    top = max(windows)
    names = []
    for w in windows:
        names += [f"rolling_flow_bytes_mean_w{w}", f"rolling_flow_packets_mean_w{w}",
                  f"rolling_short_flow_fraction_w{w}", f"rolling_syn_sum_w{w}", f"rolling_rst_sum_w{w}"]
    return names + [f"rolling_unique_destination_ports_w{top}", f"rolling_syn_ratio_w{top}",
                    f"rolling_connection_failure_ratio_w{top}", f"port_scan_pattern_score_w{top}"]


def add_totals(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns({
        "total_packets": c("total_fwd_packets") + c("total_backward_packets"),
        "total_bytes": c("total_length_of_fwd_packets") + c("total_length_of_bwd_packets"),
    })


def add_statistics(df: DataFrame) -> DataFrame:
    """The fifteen statistical features."""
    c = F.col
    active, idle = c("active_mean"), c("idle_mean")
    forward, backward = c("avg_fwd_segment_size"), c("avg_bwd_segment_size")
    headers = c("fwd_header_length") + c("bwd_header_length")
    return add_totals(df).withColumns({
        "bytes_per_packet": safe_divide("total_bytes", "total_packets"),
        "fwd_bwd_packet_ratio": safe_divide("total_fwd_packets", "total_backward_packets"),
        "fwd_bwd_byte_ratio": safe_divide("total_length_of_fwd_packets", "total_length_of_bwd_packets"),
        "packet_length_range": c("max_packet_length") - c("min_packet_length"),
        "flow_iat_cv": safe_divide("flow_iat_std", "flow_iat_mean"),
        "packet_length_cv": safe_divide("packet_length_std", "packet_length_mean"),
        "header_payload_ratio": safe_divide(headers, "total_bytes"),
        "forward_payload_efficiency": safe_divide("act_data_pkt_fwd", "total_fwd_packets"),
        "idle_active_ratio": safe_divide(idle, active),
        "burstiness_score": safe_divide(active - idle, active + idle),
        "segment_size_asymmetry": safe_divide(F.abs(forward - backward), forward + backward),
        "ack_push_ratio": safe_divide("ack_flag_count", c("psh_flag_count") + 1),
        "payload_density": safe_divide("total_bytes", "flow_duration"),
    })


def add_flag_ratios(df: DataFrame) -> DataFrame:
    """Needs `total_packets`."""
    c = F.col
    return df.withColumns({
        "syn_ratio": safe_divide("syn_flag_count", "total_packets"),
        "connection_failure_score": safe_divide(c("rst_flag_count") + c("fin_flag_count"), "total_packets"),
        "connection_reset_ratio": safe_divide("rst_flag_count", "total_packets"),
    })


def short_flow(duration: str = "flow_duration", limit: float = SHORT_FLOW) -> Column:
    return (F.col(duration) <= F.lit(limit)).cast("double")


def with_halo(
    df: DataFrame, source: str, order_col: str, reach: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Cut every source into blocks of rows and copy the last `reach` rows of a block into the next.

    Adds `_idx` (row number within the source), `_part` (block) and `_halo` (copied row). A frame of up to
    `reach` preceding rows inside (source, _part) then sees what it would see inside the source, and a
    source with a third of all rows is worked on by as many tasks as it has blocks.
    """
    if reach >= block_rows:
        raise ValueError("a block must be longer than the window reaches back")
    indexed = dense_index(df, [source], order_col, "_idx", block_rows)
    at = F.col("_idx") - 1
    tail = F.pmod(at, F.lit(block_rows)) >= block_rows - reach
    copies = F.when(tail, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = indexed.withColumn("_step", F.explode(copies))
    return spread.withColumns({
        "_part": F.floor(at / block_rows) + F.col("_step"),
        "_halo": F.col("_step") == 1,
    }).drop("_step")


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(~F.col("_halo")).drop("_halo", "_part", "_idx")


def add_rolling(
    df: DataFrame,
    windows: Sequence[int] = WINDOWS,
    source: str = "source_file",
    order_col: str = "row_id",
    short_limit: float = SHORT_FLOW,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Means, sums, distinct ports and scan score over the last rows of the same source."""
    top = max(windows)
    spread = with_halo(df.withColumn("_short", short_flow(limit=short_limit)), source, order_col, top - 1, block_rows)

    def last(w: int):
        return Window.partitionBy(source, "_part").orderBy("_idx").rowsBetween(-(w - 1), 0)

    made: dict[str, Column] = {}
    for w in windows:
        made[f"rolling_flow_bytes_mean_w{w}"] = F.avg("flow_bytes_per_s").over(last(w))
        made[f"rolling_flow_packets_mean_w{w}"] = F.avg("flow_packets_per_s").over(last(w))
        made[f"rolling_short_flow_fraction_w{w}"] = F.avg("_short").over(last(w))
        made[f"rolling_syn_sum_w{w}"] = F.sum("syn_flag_count").over(last(w)).cast("double")
        made[f"rolling_rst_sum_w{w}"] = F.sum("rst_flag_count").over(last(w)).cast("double")
    made[f"rolling_unique_destination_ports_w{top}"] = F.size(
        F.collect_set("destination_port").over(last(top))).cast("double")
    out = drop_halo(spread.withColumns(made)).drop("_short")
    out = out.withColumns({
        f"rolling_syn_ratio_w{top}": F.col(f"rolling_syn_sum_w{top}") / F.lit(float(top)),
        f"rolling_connection_failure_ratio_w{top}": F.col(f"rolling_rst_sum_w{top}") / F.lit(float(top)),
    })
    return out.withColumn(
        f"port_scan_pattern_score_w{top}",
        F.col(f"rolling_unique_destination_ports_w{top}") * F.col(f"rolling_short_flow_fraction_w{top}")
        * (F.col(f"rolling_syn_ratio_w{top}") + 1.0),
    )


def engineer(df: DataFrame, windows: Sequence[int] = WINDOWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All features of a flow table; what is not finite becomes zero."""
    require_columns(df, NEEDED, "the flow table")
    out = add_flag_ratios(add_statistics(df))
    quotients = [c for c in (*STATISTICAL, *FLAG_RATIOS) if c not in SUMS]
    return finite_frame(add_rolling(out, windows, block_rows=block_rows), 0.0, quotients)


def with_sequence(
    df: DataFrame,
    features: Sequence[str],
    length: int = SEQUENCE_LENGTH,
    source: str = "source_file",
    order_col: str = "row_id",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """`_idx` (number of the row in its source) and `sequence`: the feature arrays of the last `length` rows of the source, oldest
    first; null for rows with a shorter history."""
    packed = df.withColumn("_f", F.array(*[F.col(f).cast("double") for f in features]))
    spread = with_halo(packed, source, order_col, length - 1, block_rows)
    frame = Window.partitionBy(source, "_part").orderBy("_idx").rowsBetween(-(length - 1), 0)
    full = spread.withColumn("sequence", F.when(F.col("_idx") >= length, F.collect_list("_f").over(frame)))
    return full.where(~F.col("_halo")).drop("_halo", "_part", "_f")


def sequences(
    df: DataFrame,
    features: Sequence[str],
    length: int = SEQUENCE_LENGTH,
    stride: int = 1,
    source: str = "source_file",
    order_col: str = "row_id",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The rows with a full history and their `sequence`; with a stride, only every stride-th of them is kept."""
    full = with_sequence(df, features, length, source, order_col, block_rows).where(F.col("_idx") >= length)
    if stride > 1:
        full = full.where((F.col("_idx") - length) % stride == 0)
    return full.drop("_idx")


def select_features(df: DataFrame, features: Sequence[str],
                    metadata: Sequence[str] = ("label", "source_file", "label_binary", "label_multiclass")) -> DataFrame:
    """The chosen features and the metadata columns, keeping the row id."""
    keep = [*features, *metadata]
    require_columns(df, keep, "the engineered table")
    return df.select("row_id", *keep)
