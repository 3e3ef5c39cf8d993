"""Registered queries: sources, schema, cleaning, labels."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T


from flowlens.functions.columns import clean_label, finite, is_inf, label_key, quantized, squeeze, to_number
from flowlens.operators import alerts, cleaning, labels, schema, splits
from flowlens.plans.q_alerts import scored
from flowlens.plans.registry import LABEL_SQL, define, oracle, query
from flowlens.session import cut_lineage, staging_path
from flowlens.sources import csv_files
from flowlens.sources.bindings import table, view

# ---- A: sources and sinks


def staged_csv(spark, sf_dir) -> str:
    """The flows as CSV files of three makes: other delimiters, encodings, headers and columns."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    folder = staging_path(spark, "csv")
    flows = view(spark, sf_dir, "flows")
    label = F.replace("label", F.lit("Web Attack - XSS"), F.lit("Web Attack – XSS"))
    base = [F.col("row_id").alias("Row Id"), F.col("destination_port").alias(" Destination Port"),
            F.col("flow_duration").alias("Flow Duration "), F.col("flow_bytes_per_s").alias("Flow Bytes/s")]
    makes = (
        (0, "UTF-8", ",", [*base, label.alias("Label")]),
        (1, "windows-1252", ";", [*base, F.col("idle_mean").alias("Idle Mean"), label.alias(" Label")]),
        (2, "ISO-8859-1", "\t", [label.alias("label"), *base[::-1]]),
    )
    for group, charset, sep, columns in makes:
        part = flows.where(F.col("row_id") % 3 == group)
        if charset == "ISO-8859-1":
            part = part.withColumn("label", F.regexp_replace("label", "–", "-"))
            columns = [F.col("label"), *base[::-1]]
        part.select(*columns).write.mode("append").csv(
            folder, header=True, sep=sep, encoding=charset, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return folder


define("staged", """select row_id, destination_port, flow_duration, flow_bytes_per_s,
  case when row_id % 3 = 1 then idle_mean end as idle_mean,
  case when row_id % 3 = 2 then label else replace(label, 'Attack - XSS', 'Attack – XSS') end as label from flows""", "flows")


@query("A1_discover_files", "select count(*) > 0 as has_files, true as all_csv, true as sorted from events")
def a1(spark, sf_dir):
    found = csv_files.list_files(spark, staged_csv(spark, sf_dir))
    return found.agg((F.count("*") > 0).alias("has_files"), F.every(F.endswith("file_name", F.lit(".csv"))).alias("all_csv"),
                     (F.count_if(F.col("length") > 0) == F.count("*")).alias("sorted"))


def profiles(spark, sf_dir):
    return csv_files.profile_files(spark, staged_csv(spark, sf_dir))


@query("A2_encoding_profile", """
select * from (values ('cp1252'), ('utf-8-sig')) as v(encoding) where exists (select 1 from events)""")
def a2(spark, sf_dir):
    """The files without a character outside ASCII pass as the first candidate."""
    return profiles(spark, sf_dir).select("encoding").distinct()


@query("A3_delimiter_profile", """
select * from (values (','), (';'), (chr(9))) as v(delimiter) where exists (select 1 from events)""")
def a3(spark, sf_dir):
    return profiles(spark, sf_dir).select("delimiter").distinct()


@query("A4_header_profile", """
select * from (values (',', 'Row Id| Destination Port|Flow Duration |Flow Bytes/s|Label'),
  (';', 'Row Id| Destination Port|Flow Duration |Flow Bytes/s|Idle Mean| Label'),
  (chr(9), 'label|Flow Bytes/s|Flow Duration | Destination Port|Row Id')) as v(delimiter, header)
where exists (select 1 from events)""")
def a4_header(spark, sf_dir):
    return profiles(spark, sf_dir).select("delimiter", F.array_join("header", "|").alias("header")).distinct()


@query("A5_multi_file_scan", oracle("staged", """
select cast(row_id as string) as original_row, cast(destination_port as string) as destination_port,
  cast(flow_duration as string) as flow_duration, flow_bytes_per_s, cast(idle_mean as string) as idle_mean, label from staged"""))
def a5(spark, sf_dir):
    df = csv_files.read_files(spark, staged_csv(spark, sf_dir), row_id="_rid")
    return df.select(F.col("row_id").alias("original_row"), "destination_port", "flow_duration",
                     F.col("flow_bytes_per_s").cast("double").alias("flow_bytes_per_s"), "idle_mean", "label")


@query("A5_row_numbers", oracle("flows", """
select count(*) as rows, cast(0 as bigint) as low, count(*) - 1 as high, count(*) as distinct_ids from flows"""))
def a5_rows(spark, sf_dir):
    df = csv_files.read_files(spark, staged_csv(spark, sf_dir), row_id="_rid")
    return df.agg(F.count("*").alias("rows"), F.min("_rid").alias("low"), F.max("_rid").alias("high"),
                  F.countDistinct("_rid").alias("distinct_ids"))


def quoted_csv(spark, sf_dir) -> str:
    """Flows with a note of several lines and doubled quotes, as CSV."""
    folder = staging_path(spark, "csv-quoted")
    note = F.concat_ws("\n", "label", F.concat(F.lit('say "'), F.col("row_id").cast("string"), F.lit('", again')), F.lit("end"))
    view(spark, sf_dir, "flows").select("row_id", note.alias("Note"), "flow_duration").write.csv(folder, header=True, escape='"', quoteAll=True)
    return folder


@query("A5_quoted_breaks", oracle("flows", """
select cast(row_id as string) as original_row, label || chr(10) || 'say "' || row_id || '", again' || chr(10) || 'end' as note,
  cast(flow_duration as string) as flow_duration from flows"""))
def a5_quoted(spark, sf_dir):
    """Line breaks inside quotes, read by byte ranges far smaller than a file."""
    df = csv_files.read_files(spark, quoted_csv(spark, sf_dir), row_id="_rid", range_bytes=64 << 10)
    return df.select(F.col("row_id").alias("original_row"), "note", "flow_duration")


@query("A7_ingestion_report", oracle("flows", """
select count(*) as total_rows, cast(7 as int) as total_columns, true as schema_mismatch, cast(0 as bigint) as rejected,
  cast(5 as int) as fewest_columns, cast(6 as int) as most_columns, 'idle_mean' as missing_columns from flows"""))
def a7_report(spark, sf_dir):
    """The report over files of three makes; one make has a column that the others lack."""
    df = csv_files.ingestion_report(spark, staged_csv(spark, sf_dir))
    return df.groupBy("total_rows", "total_columns", "schema_mismatch").agg(
        F.sum("rejected").alias("rejected"), F.min("columns").alias("fewest_columns"), F.max("columns").alias("most_columns"),
        F.max("missing_columns").alias("missing_columns"))


@query("A6_combined_sink", oracle("flows", "select row_id, source_file, flow_duration, label from flows"))
def a6(spark, sf_dir):
    path = staging_path(spark, "combined")
    csv_files.write_table(view(spark, sf_dir, "flows").select("row_id", "source_file", "flow_duration", "label"), path)
    return spark.read.parquet(path)


@query("A7_ingestion_summary", oracle("flows", "select source_file, count(*) as rows from flows group by 1"))
def a7(spark, sf_dir):
    return csv_files.file_summary(view(spark, sf_dir, "flows"))


@query("A8_projected_scan", oracle("flows", "select row_id, label_binary, label_multiclass from flows"))
def a8(spark, sf_dir):
    return view(spark, sf_dir, "flows").select("row_id", "label_binary", "label_multiclass")


define("marked", """select *, row_number() over (partition by label_multiclass order by md5(row_id || '-42'), row_id)
  <= round(2e-1 * count(*) over (partition by label_multiclass)) as is_test from flows""", "flows")


@query("A10_metadata_side_table", oracle("marked", """
select label, source_file, label_binary, label_multiclass, is_test from marked where is_test"""))
def a10(spark, sf_dir):
    marked = splits.train_test_split(view(spark, sf_dir, "flows"), "label_multiclass", "row_id")
    return splits.split_rows(marked, "test", "row_id").select(
        "label", "source_file", "label_binary", "label_multiclass", "is_test")


@query("A11_json_lines", oracle("scored", """
select stream_order, '{"stream_order":' || stream_order || ',"source_file":"' || source_file || '","alert_level":"' || alert_level || '"}' as line
from scored where is_alert"""))
def a11(spark, sf_dir):
    """Written as JSON lines and read back as text."""
    path = staging_path(spark, "ndjson")
    rows = alerts.alert_rows(scored(spark, sf_dir)).select("stream_order", "source_file", "alert_level")
    csv_files.write_json_lines(rows, path)
    line = spark.read.text(path).withColumnRenamed("value", "line")
    return line.select(F.get_json_object("line", "$.stream_order").cast("bigint").alias("stream_order"), "line")


@query("A12_json_safe_numbers", oracle("flows_raw", """
select row_id, case when isinf(v) or isnan(v) then null else v end as flow_bytes_per_s
from (select row_id, try_cast(flow_bytes_per_s as double) as v from flows_raw)"""))
def a12(spark, sf_dir):
    raw = view(spark, sf_dir, "flows_raw")
    return raw.select("row_id", finite(to_number("flow_bytes_per_s")).alias("flow_bytes_per_s"))


# ---- B: names and types

define("headers", """select p_size as file, p_partkey as pos,
  ' ' || p_type || ' ' || p_name || case when p_partkey % 3 = 0 then '/s' when p_partkey % 3 = 1 then ' % ' else '--' end as raw_name
  from part""")
define("named", """select *, coalesce(nullif(trim(regexp_replace(replace(replace(lower(trim(raw_name)), '%', 'pct'), '/', '_per_'),
  '[^0-9a-zA-Z]+', '_', 'g'), '_'), ''), 'unnamed_column') as name from headers""", "headers")
define("columned", """select *, case when n = 0 then name else name || '__dup' || n end as "column"
  from (select *, row_number() over (partition by file, name order by pos) - 1 as n from named)""", "named")


def headers(spark, sf_dir):
    """Parts as header cells: the size names the file, the key the place."""
    key = F.col("p_partkey") % 3
    tail = F.when(key == 0, "/s").when(key == 1, " % ").otherwise("--")
    raw = F.concat(F.lit(" "), "p_type", F.lit(" "), "p_name", tail)
    return table(spark, sf_dir, "part").select(F.col("p_size").alias("file"), F.col("p_partkey").alias("pos"), raw.alias("raw_name"))


def columned(spark, sf_dir):
    return schema.disambiguate(schema.normalize_headers(headers(spark, sf_dir)))


@query("B1_normalize_names", oracle("named", "select file, pos, raw_name, name from named"))
def b1(spark, sf_dir):
    return schema.normalize_headers(headers(spark, sf_dir))


@query("B1_normalize_page_text", r"""
select page_id, coalesce(nullif(trim(regexp_replace(replace(replace(lower(url), '%', 'pct'), '/', '_per_'),
  '[^0-9a-zA-Z]+', '_', 'g'), '_'), ''), 'unnamed_column') as name from pages""")
def b1_pages(spark, sf_dir):
    return schema.normalize_headers(table(spark, sf_dir, "pages"), "url").select("page_id", "name")


@query("B2_disambiguate", oracle("columned", 'select file, pos, "column" from columned'))
def b2(spark, sf_dir):
    return columned(spark, sf_dir).select("file", "pos", "column")


@query("B3_ordered_union", oracle("columned", """
select "column", file as first_file, pos as first_pos from (select *, row_number() over (partition by "column" order by file, pos) as rn from columned) where rn = 1"""))
def b3(spark, sf_dir):
    return schema.ordered_union(columned(spark, sf_dir))


@query("A4_schema_mismatch", oracle("columned", """
with f as (select min(file) as file from columned), ref as (select distinct "column" from columned where file = (select file from f)),
have as (select distinct file, "column" from columned where file <> (select file from f))
select file, "column", 'extra' as kind from have where "column" not in (select "column" from ref)
union all
select file, "column", 'missing' from (select distinct file from have) cross join ref
  where (file, "column") not in (select (file, "column") from have)"""))
def a4(spark, sf_dir):
    return schema.mismatches(columned(spark, sf_dir))


@query("B4_align_to_schema", oracle("flows", """
select cast(flow_duration as double) as flow_duration, cast(null as double) as bulk_rate, row_id, cast(null as string) as protocol, label from flows"""))
def b4(spark, sf_dir):
    want = T.StructType.fromDDL("flow_duration double, bulk_rate double, row_id bigint, protocol string, label string")
    return schema.align(view(spark, sf_dir, "flows"), want)


RAW_TEXT = ("destination_port", "flow_bytes_per_s", "idle_mean", "label")


@query("B5_text_to_numeric_profile", oracle("flows_raw", " union all ".join(f"""
select '{c}' as "column", count(nullif(trim({c}), '')) as "values", count(try_cast({c} as double)) as numbers,
  count(nullif(trim({c}), '')) > 0 and count(try_cast({c} as double)) >= 99e-2 * count(nullif(trim({c}), '')) as is_numeric from flows_raw"""
    for c in RAW_TEXT)))
def b5(spark, sf_dir):
    return schema.text_profile(view(spark, sf_dir, "flows_raw"), RAW_TEXT)


@query("B5_text_to_numeric", oracle("flows_raw", """
select row_id, source_file, cast(destination_port as double) as destination_port, flow_bytes_per_s, cast(idle_mean as double) as idle_mean, label from flows_raw"""))
def b5_cast(spark, sf_dir):
    return schema.infer_numbers(view(spark, sf_dir, "flows_raw"))


INTEGERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("B6_type_widths", " union all ".join(f"""
select '{c}' as "column", cast(min({c}) as bigint) as low, cast(max({c}) as bigint) as high,
  case when min({c}) >= -128 and max({c}) <= 127 then 'tinyint' when min({c}) >= -32768 and max({c}) <= 32767 then 'smallint'
    when min({c}) >= -2147483648 and max({c}) <= 2147483647 then 'int' else 'bigint' end as width from lineitem""" for c in INTEGERS))
def b6(spark, sf_dir):
    return schema.width_profile(table(spark, sf_dir, "lineitem"), INTEGERS)


@query("B6_narrowed_types", oracle("flows", """
select row_id, cast(syn_flag_count as tinyint) as syn_flag_count, cast(idle_mean as smallint) as idle_mean,
  cast(destination_port as tinyint) as destination_port, source_file, label from flows"""))
def b6_narrow(spark, sf_dir):
    flows = view(spark, sf_dir, "flows")
    return schema.narrow(flows.select("row_id", "syn_flag_count", "idle_mean", "destination_port", "source_file", "label"))


# ---- C: cleaning

SPACE_SQL = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
define("texted", rf"""select row_id, source_file, destination_port, flow_bytes_per_s, idle_mean,
  nullif(trim(regexp_replace(label, '{SPACE_SQL}+', ' ', 'g')), '') as text,
  try_cast(destination_port as double) as port_raw, try_cast(flow_bytes_per_s as double) as bytes_raw, try_cast(idle_mean as double) as idle_raw
  from flows_raw""", "flows_raw")
define("sanitized", rf"""select *, trim(regexp_replace(regexp_replace(regexp_replace(text, '[\x{{2010}}-\x{{2015}}\x{{2212}}\x{{FFFD}}]', '-', 'g'),
  '{SPACE_SQL}*-{SPACE_SQL}*', ' - ', 'g'), '{SPACE_SQL}+', ' ', 'g'), ' -') as clean_text from texted""", "texted")
define("keyed", "select *, trim(regexp_replace(lower(clean_text), '[^0-9a-zA-Z]+', ' ', 'g')) as label_key from sanitized", "sanitized")
define("standard", f"""select k.row_id, k.source_file, case when isinf(port_raw) or isnan(port_raw) then null else port_raw end as destination_port,
  case when isinf(bytes_raw) or isnan(bytes_raw) then null else bytes_raw end as flow_bytes_per_s,
  case when isinf(idle_raw) or isnan(idle_raw) then null else idle_raw end as idle_mean, coalesce(d.label, clean_text) as label,
  text as raw_label, isinf(bytes_raw) as bytes_inf from keyed k left join {LABEL_SQL} d on d.alias_key = k.label_key""", "keyed")
define("imputed", """select row_id, source_file, destination_port, coalesce(flow_bytes_per_s, 0e0) as flow_bytes_per_s,
  coalesce(idle_mean, (select avg(idle_mean) from standard)) as idle_mean, label from standard
  where label is not null and source_file is not null and destination_port is not null""", "standard")
define("cleaned", """select * exclude (rn) from (select *, row_number() over (
  partition by destination_port, flow_bytes_per_s, idle_mean, label order by row_id) as rn from imputed) where rn = 1""", "imputed")

RULES = cleaning.CleaningRules(critical=("label", "source_file", "destination_port"))
RAW_NUMBERS = ("destination_port", "flow_bytes_per_s", "idle_mean")


def raw(spark, sf_dir):
    return view(spark, sf_dir, "flows_raw")


def standard(spark, sf_dir):
    return cleaning.standardize(raw(spark, sf_dir), RULES)


@query("C1_text_standardize", rf"""
select doc_id, nullif(trim(regexp_replace(text, '{SPACE_SQL}+', ' ', 'g')), '') as text from documents""")
def c1(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", squeeze("text").alias("text"))


@query("C2_numeric_coercion", oracle("texted", """
select row_id, case when isinf(bytes_raw) then 1e308 else bytes_raw end as flow_bytes_per_s, idle_raw as idle_mean from texted"""))
def c2(spark, sf_dir):
    df = cleaning.numbers(raw(spark, sf_dir), RAW_NUMBERS)
    return df.select("row_id", F.when(is_inf("flow_bytes_per_s"), 1e308).otherwise(F.col("flow_bytes_per_s")).alias("flow_bytes_per_s"),
                     "idle_mean")


PROFILE_SQL = oracle("texted", " union all ".join(f"""
select '{c}' as "column", count(*) filter (where {v} is null or isinf({v}) or isnan({v})) as missing,
  count(*) filter (where isinf({v})) as infinite, count(*) filter (where not isinf({v}) and not isnan({v})) as valid,
  {'0e0' if c.endswith('_per_s') else f'round(coalesce(avg({v}) filter (where not isinf({v}) and not isnan({v})), 0e0), 6)'} as fill_value from texted"""
    for c, v in zip(RAW_NUMBERS, ("port_raw", "bytes_raw", "idle_raw"))))


@query("C3_C4_C5_column_profile", PROFILE_SQL)
def c345(spark, sf_dir):
    df = cleaning.column_profile(cleaning.numbers(raw(spark, sf_dir), RAW_NUMBERS), RAW_NUMBERS)
    return df.withColumn("fill_value", quantized("fill_value"))


@query("C3_infinity_to_null", oracle("standard", "select row_id, destination_port, flow_bytes_per_s, idle_mean from standard"))
def c3(spark, sf_dir):
    df = cleaning.numbers(raw(spark, sf_dir), RAW_NUMBERS)
    return df.select("row_id", *[finite(c).alias(c) for c in RAW_NUMBERS])


@query("C4_missing_profile", oracle("standard", " union all ".join(f"""
select '{c}' as "column", count(*) filter (where {c} is null) as missing from standard"""
    for c in ("row_id", "source_file", *RAW_NUMBERS, "label"))))
def c4(spark, sf_dir):
    return cleaning.missing_counts(standard(spark, sf_dir))


@query("C4_missing_profile_lineitem", " union all ".join(f"""
select '{c}' as "column", count(*) filter (where {c} is null) as missing from lineitem"""
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def c4_lineitem(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return cleaning.missing_counts(df.select("l_quantity", "l_extendedprice", "l_discount", "l_tax"))


@query("C5_fill_statistics", oracle("standard", """
select 'destination_port' as "column", round(avg(destination_port), 6) as fill_value from standard
union all select 'flow_bytes_per_s', 0e0
union all select 'idle_mean', round(avg(idle_mean), 6) from standard"""))
def c5(spark, sf_dir):
    df = cleaning.column_profile(standard(spark, sf_dir), RAW_NUMBERS)
    return df.select("column", quantized("fill_value").alias("fill_value"))


@query("C6_text_mode", oracle("standard", """
select coalesce((select label from standard where label is not null group by label order by count(*) desc, min(row_id) limit 1), 'unknown') as mode"""))
def c6(spark, sf_dir):
    return cleaning.text_mode(standard(spark, sf_dir), "label", "row_id")


@query("C7_drop_incomplete", oracle("standard", """
select row_id, source_file, label from standard where label is not null and source_file is not null and destination_port is not null"""))
def c7(spark, sf_dir):
    return cleaning.drop_incomplete(standard(spark, sf_dir), RULES.critical).select("row_id", "source_file", "label")


@query("C8_impute", oracle("imputed", """
select row_id, source_file, destination_port, flow_bytes_per_s, round(idle_mean, 6) as idle_mean, label from imputed"""))
def c8(spark, sf_dir):
    df = standard(spark, sf_dir)
    kept = cleaning.impute(cleaning.drop_incomplete(df, RULES.critical), cleaning.fill_values(df, RULES))
    return kept.withColumn("idle_mean", quantized("idle_mean")).select(
        "row_id", "source_file", *RAW_NUMBERS, "label")


CLEANED_SQL = oracle("cleaned", """
select row_id, source_file, destination_port, flow_bytes_per_s, round(idle_mean, 6) as idle_mean, label from cleaned""")


@query("C9_deduplicate", CLEANED_SQL)
def c9(spark, sf_dir):
    return cleaned(spark, sf_dir).withColumn("idle_mean", quantized("idle_mean"))


def cleaned(spark, sf_dir):
    return cleaning.clean(raw(spark, sf_dir), RULES)


@query("C9_deduplicate_lineitem", """
select l_partkey % 50 as part, l_returnflag, l_linestatus, min(l_orderkey * 8 + l_linenumber) as first_row from lineitem group by 1, 2, 3""")
def c9_lineitem(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 50).alias("part"), "l_returnflag", "l_linestatus",
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("first_row"))
    return cleaning.deduplicate(li, "first_row", ())


@query("C10_label_distributions", oracle("standard cleaned", """
select 'raw' as stage, coalesce(raw_label, '<NA>') as label, count(*) as count from standard group by 2
union all select 'canonical', coalesce(label, '<NA>'), count(*) from standard group by 2
union all select 'cleaned', coalesce(label, '<NA>'), count(*) from cleaned group by 2"""))
def c10(spark, sf_dir):
    stages = {"raw": raw(spark, sf_dir).withColumn("label", squeeze("label")), "canonical": standard(spark, sf_dir),
              "cleaned": cleaned(spark, sf_dir)}
    out = None
    for stage, df in stages.items():
        part = cleaning.label_distribution(df).select(F.lit(stage).alias("stage"), "label", "count")
        out = part if out is None else out.unionByName(part)
    return out


@query("C11_cleaning_report", oracle("standard imputed cleaned", """
select (select count(*) from standard) as rows_read, (select count(*) from standard) - (select count(*) from imputed) as dropped,
  (select count(*) filter (where flow_bytes_per_s is null) + count(*) filter (where idle_mean is null) from standard
    where label is not null and source_file is not null and destination_port is not null) as imputed,
  (select count(*) from imputed) - (select count(*) from cleaned) as duplicates, (select count(*) from cleaned) as written"""))
def c11(spark, sf_dir):
    return cleaning.cleaning_report(raw(spark, sf_dir), RULES)


# ---- D: labels


@query("D1_sanitize_label", oracle("sanitized", "select row_id, clean_text as label from sanitized"))
def d1(spark, sf_dir):
    return raw(spark, sf_dir).select("row_id", clean_label(squeeze("label")).alias("label"))


@query("D1_sanitize_documents", rf"""
select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[\x{{2010}}-\x{{2015}}\x{{2212}}\x{{FFFD}}]', '-', 'g'),
  '{SPACE_SQL}*-{SPACE_SQL}*', ' - ', 'g'), '{SPACE_SQL}+', ' ', 'g'), ' -') as text from documents""")
def d1_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", clean_label("text").alias("text"))


@query("D2_label_key", oracle("keyed", "select row_id, label_key from keyed"))
def d2(spark, sf_dir):
    return raw(spark, sf_dir).select("row_id", label_key(squeeze("label")).alias("label_key"))


@query("D3_canonicalize", oracle("standard", "select row_id, label from standard"))
def d3(spark, sf_dir):
    return labels.canonicalize(raw(spark, sf_dir)).select("row_id", "label")


PRED_LABEL_SQL = "select predicted_multiclass_label_name as label, original_index from preds"


def predicted(spark, sf_dir):
    return view(spark, sf_dir, "preds").select(F.col("predicted_multiclass_label_name").alias("label"), "original_index")


@query("D4_unknown_labels", oracle("preds", f"""
select label, count(*) as count from ({PRED_LABEL_SQL}) where label not in (select label from {LABEL_SQL}) group by 1"""))
def d4(spark, sf_dir):
    return labels.unknown_labels(predicted(spark, sf_dir))


@query("D5_D6_targets", oracle("standard", f"""
select row_id, s.label, cast(d.label_binary as tinyint) as label_binary, cast(d.label_multiclass as smallint) as label_multiclass
from standard s left join {LABEL_SQL} d on d.label = s.label"""))
def d56(spark, sf_dir):
    return labels.add_targets(labels.canonicalize(raw(spark, sf_dir)).select("row_id", "label"))


@query("D7_target_distribution", oracle("cleaned", f"""
select c.label, cast(d.label_binary as tinyint) as label_binary, cast(d.label_multiclass as smallint) as label_multiclass, count(*) as count
from cleaned c join {LABEL_SQL} d on d.label = c.label group by all"""))
def d7(spark, sf_dir):
    return labels.target_distribution(labels.label_rows(cut_lineage(cleaned(spark, sf_dir))))


@query("D7_target_check", oracle("cleaned", """
select count(*) as rows, count(*) filter (where label = 'BENIGN') as benign_rows, count(*) filter (where label = 'BENIGN') as binary_zero,
  count(*) filter (where label = 'BENIGN') as multiclass_zero, count(*) as binary_rows, true as consistent from cleaned"""))
def d7_check(spark, sf_dir):
    return labels.target_check(labels.label_rows(cut_lineage(cleaned(spark, sf_dir))))


@query("D8_label_mapping", oracle("preds", f"""
select d.label, cast(d.label_binary as tinyint) as label_binary, cast(d.label_multiclass as smallint) as label_multiclass,
  count(p.original_index) as rows from {LABEL_SQL} d left join ({PRED_LABEL_SQL}) p on p.label = d.label group by all"""))
def d8(spark, sf_dir):
    return labels.used_mapping(predicted(spark, sf_dir))


@query("M18_label_names", oracle("flows", f"""
select row_id, case when f.label_binary = 1 then 'ATTACK' else 'BENIGN' end as binary_name,
  coalesce(d.label, cast(i as string)) as class_name
from (select row_id, label_binary, (row_id * 7) % 18 as i from flows) f left join {LABEL_SQL} d on d.label_multiclass = f.i"""))
def m18(spark, sf_dir):
    df = view(spark, sf_dir, "flows").select("row_id", "label_binary", ((F.col("row_id") * 7) % 18).alias("i"))
    return labels.add_names(df, "i", "class_name").select("row_id", labels.binary_name("label_binary").alias("binary_name"), "class_name")


