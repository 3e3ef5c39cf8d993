"""Views over the given tables that have the shape of flows, predictions and detector scores.

The texts run unchanged in Spark SQL and in the SQL engine that checks the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.session import prepare

FLOWS = """
select event_id as row_id,
  concat('source_', user_id % 8, '.csv') as source_file,
  cast(substr(props, 7, length(props) - 7) as int) as destination_port,
  cast(round(value * 100) as bigint) * 100 as flow_duration,
  value as flow_bytes_per_s,
  (event_id * 31) % 977 as flow_packets_per_s,
  1 + user_id % 7 as total_fwd_packets,
  event_id % 5 as total_backward_packets,
  (1 + user_id % 7) * (20 + event_id % 13) as total_length_of_fwd_packets,
  (event_id % 5) * 10 as total_length_of_bwd_packets,
  60 + event_id % 100 as max_packet_length,
  20 + event_id % 7 as min_packet_length,
  30 + event_id % 50 as packet_length_mean,
  5 + event_id % 11 as packet_length_std,
  1000 + event_id % 601 as flow_iat_mean,
  100 + event_id % 37 as flow_iat_std,
  40 + event_id % 17 as fwd_header_length,
  20 + event_id % 19 as bwd_header_length,
  user_id % 7 as act_data_pkt_fwd,
  case when event_type = 'click' then 1 else 0 end as syn_flag_count,
  case when event_type = 'error' then 1 else 0 end as rst_flag_count,
  case when event_type = 'signup' then 1 else 0 end as fin_flag_count,
  2 + event_id % 4 as ack_flag_count,
  event_id % 2 as psh_flag_count,
  (event_id * 3) % 2000 as idle_mean,
  (event_id * 7) % 500 as active_mean,
  25 + event_id % 23 as avg_fwd_segment_size,
  10 + event_id % 29 as avg_bwd_segment_size,
  case event_type when 'view' then 'BENIGN' when 'click' then 'DDoS' when 'error' then 'PortScan'
    when 'signup' then 'Web Attack - XSS' else 'Bot' end as label,
  case when event_type = 'view' then 0 else 1 end as label_binary,
  case event_type when 'view' then 0 when 'click' then 2 when 'error' then 10
    when 'signup' then 14 else 1 end as label_multiclass
from events
"""

FLOWS_RAW = """
select event_id as row_id, concat('source_', user_id % 8, '.csv') as source_file,
  cast(user_id as string) as destination_port,
  case when event_id % 50 = 0 then 'inf' when event_id % 31 = 0 then ''
    when event_id % 29 = 0 then 'n/a' else cast(value as string) end as flow_bytes_per_s,
  case when event_id % 41 = 0 then null else cast(event_id % 997 as string) end as idle_mean,
  case when event_id % 97 = 0 then null when event_type = 'view' then ' BENIGN '
    when event_type = 'click' then 'ddos' when event_type = 'error' then 'PortScan'
    when event_type = 'signup' then 'Web Attack – XSS' else 'Bot' end as label
from events
union all
select event_id + 100000000, 'copy.csv', cast(user_id as string),
  case when event_id % 50 = 0 then 'inf' when event_id % 31 = 0 then ''
    when event_id % 29 = 0 then 'n/a' else cast(value as string) end,
  case when event_id % 41 = 0 then null else cast(event_id % 997 as string) end,
  case when event_type = 'view' then ' BENIGN ' else 'Bot' end
from events
where event_id % 20 = 0 and event_type in ('view', 'purchase')
"""

PREDS = """
select event_id as stream_order, event_id as original_index, ts as event_time_utc,
  concat('source_', user_id % 8, '.csv') as source_file,
  case when event_type = 'view' then 0 else 1 end as true_binary_label,
  case event_type when 'view' then 'BENIGN' when 'click' then 'DDoS' when 'error' then 'PortScan'
    when 'signup' then 'Web Attack - XSS' else 'Bot' end as true_multiclass_label_name,
  ((event_id * 37) % 1000 + case when event_type = 'view' then 0 else 400 end) / 1400e0
    as binary_attack_probability,
  case (event_id * 13) % 5 when 0 then 'BENIGN' when 1 then 'DDoS' when 2 then 'PortScan'
    when 3 then 'Heartbleed' else 'Mystery' end as predicted_multiclass_label_name,
  ((event_id * 53) % 1000) / 1000e0 as multiclass_confidence
from events
"""

ANOM = """
select event_id as original_index,
  (600 + (event_id * 71) % 400) / 1000e0 as p1,
  ((event_id * 83) % 1000) / 1000e0 as p2,
  (500 + (event_id * 97) % 500) / 1000e0 as p3,
  (700 + (event_id * 101) % 300) / 1000e0 as p4
from events
"""

# Probabilities of three components over five classes, one column each.
CLASSES = (0, 1, 2, 10, 14)
COMPONENTS = ("c0", "c1", "c2")
COMPS = """
select event_id as row_id, case event_type when 'view' then 0 when 'click' then 2 when 'error' then 10
    when 'signup' then 14 else 1 end as label_multiclass,
""" + ",\n".join(
    f"  ((event_id * {31 + 6 * c} + {97 * k * (c + 2)}) % 1000) / 1000e0 as c{c}k{k}" for c in range(3) for k in range(5)
) + """
from events
"""

SOURCE_TABLE = "events"
TEXTS = {"flows": FLOWS, "flows_raw": FLOWS_RAW, "preds": PREDS, "anom": ANOM, "comps": COMPS}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived views; the file scan reads only the columns a query needs."""
    text = TEXTS[name].replace("from events", "from {events}")
    return spark.sql(text, events=table(spark, sf_dir, SOURCE_TABLE))


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, features array<double>, label."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("features"), "label"
    )


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, label_multiclass and one probability array per component."""
    df = view(spark, sf_dir, "comps")
    return df.select("row_id", "label_multiclass", *[
        F.array(*[f"{c}k{k}" for k in range(len(CLASSES))]).alias(c) for c in COMPONENTS])
