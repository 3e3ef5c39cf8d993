"""Cleaning of raw flow tables: statistics over all rows first, then drop, impute, deduplicate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from flowlens.functions.local import local_table
from flowlens.functions.columns import finite, is_inf, require_columns, squeeze, to_number
from flowlens.operators.labels import canonicalize, unknown_labels
from flowlens.operators.ordering import MAX_BROADCAST_ROWS

ZERO_SUFFIXES = ("_per_s", "_ratio", "_rate")
CRITICAL = ("label", "source_file", "destination_port", "flow_duration", "total_fwd_packets", "total_backward_packets")


@dataclass(frozen=True)
class CleaningRules:
    critical: Sequence[str] = CRITICAL
    label: str = "label"
    source: str = "source_file"
    row_id: str = "row_id"
    zero_suffixes: Sequence[str] = ZERO_SUFFIXES
    compatibility_forms: bool = True

    def features(self, df: DataFrame) -> list[str]:
        return [c for c in df.columns if c not in (self.label, self.source, self.row_id)]


def numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns to numbers; what is no number becomes null. Infinities stay."""
    return df.withColumns({c: to_number(c) for c in columns})


def standardize(df: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """Numeric features without infinities, squeezed texts, canonical labels."""
    out = df.withColumns({c: finite(to_number(c)) for c in rules.features(df)})
    out = out.withColumns({rules.source: squeeze(rules.source), rules.label: squeeze(rules.label)})
    return canonicalize(out, rules.label, rules.label, rules.compatibility_forms).select(*df.columns)


def column_profile(df: DataFrame, columns: Sequence[str], zero_suffixes: Sequence[str] = ZERO_SUFFIXES) -> DataFrame:
    """column, missing, infinite, valid, fill_value for numeric columns that may hold infinities. One pass."""
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        aggs += [F.count_if(finite(x).isNull()).alias(f"_m{i}"), F.count_if(is_inf(x)).alias(f"_i{i}"),
                 F.count(finite(x)).alias(f"_v{i}"), F.avg(finite(x)).alias(f"_a{i}")]
    cells = []
    for i, c in enumerate(columns):
        zero = any(c.endswith(s) for s in zero_suffixes)
        fill = F.lit(0.0) if zero else F.coalesce(F.col(f"_a{i}"), F.lit(0.0))
        cells.append(F.struct(
            F.lit(c).alias("column"), F.col(f"_m{i}").alias("missing"), F.col(f"_i{i}").alias("infinite"),
            F.col(f"_v{i}").alias("valid"), fill.alias("fill_value")))
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def missing_counts(df: DataFrame) -> DataFrame:
    """column, missing for every column of any type."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`_m_{c}`").alias("missing")) for c in df.columns])
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"_m_{c}") for c in df.columns]).select(F.inline(cells))


def text_mode(df: DataFrame, column: str, row_id: str) -> DataFrame:
    """The most frequent value (the first seen among equals), or "unknown". One row."""
    best = (
        df.where(F.col(column).isNotNull()).groupBy(column)
        .agg(F.count("*").alias("_n"), F.min(row_id).alias("_first"))
        .agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_first"), F.col(column).alias("value"))).alias("_b"))
    )
    return best.select(F.coalesce("_b.value", F.lit("unknown")).alias("mode"))


def drop_incomplete(df: DataFrame, critical: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(critical))


def impute(df: DataFrame, fills: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fills.items()}) if fills else df


def deduplicate(df: DataFrame, row_id: str, ignored: Sequence[str] = ("source_file",)) -> DataFrame:
    """First row of every set of equal rows.

    An aggregate instead of a window: copies meet in the map-side buffers, so a row repeated a billion times
    costs one buffer per task. A text that is carried but not compared is numbered first; with number-only
    buffers the aggregate hashes instead of sorting.
    """
    carried = [c for c in ignored if c in df.columns]
    keys = [c for c in df.columns if c not in (*carried, row_id)]
    if len(carried) != 1:
        first = df.groupBy(*keys).agg(F.min(F.struct(row_id, *carried)).alias("_first"))
        return first.select(*keys, "_first.*").select(*df.columns)
    name = carried[0]
    names = [r[0] for r in df.select(name).distinct().limit(MAX_BROADCAST_ROWS + 1).collect()]
    if len(names) > MAX_BROADCAST_ROWS:
        first = df.groupBy(*keys).agg(F.min(F.struct(row_id, name)).alias("_first"))
        return first.select(*keys, "_first.*").select(*df.columns)
    coded = local_table(df.sparkSession, list(enumerate(sorted(n for n in names if n is not None))), f"_code int, _name string")
    numbered = df.join(F.broadcast(coded), F.col(name) == F.col("_name"), "left").drop(name, "_name")
    first = numbered.groupBy(*keys).agg(F.min(row_id).alias(row_id), F.min_by("_code", row_id).alias("_code"))
    return first.join(F.broadcast(coded.withColumnRenamed("_name", name)), "_code", "left").select(*df.columns)


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(F.coalesce(label, F.lit("<NA>")).alias("label")).agg(F.count("*").alias("count"))


def fill_values(standard: DataFrame, rules: CleaningRules) -> dict[str, object]:
    """Fill value per column that may be filled: two small aggregates, read on the driver."""
    names = rules.features(standard)
    fills = {r["column"]: r["fill_value"]
             for r in column_profile(standard, names, rules.zero_suffixes).collect()} if names else {}
    for text in (rules.label, rules.source):
        if text not in rules.critical:
            fills[text] = text_mode(standard, text, rules.row_id).first()[0]
    return {c: v for c, v in fills.items() if c not in rules.critical}


def clean(df: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """The whole chain. Statistics see every row; rows are then dropped, filled and deduplicated."""
    require_columns(df, [*rules.critical, rules.label, rules.source, rules.row_id], "the raw flow table")
    standard = standardize(df, rules)
    complete = drop_incomplete(standard, rules.critical)
    return deduplicate(impute(complete, fill_values(standard, rules)), rules.row_id, (rules.source,))


def cleaning_report(df: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """One row: read, dropped, imputed, duplicate and written rows."""
    standard = standardize(df, rules)
    fills = fill_values(standard, rules)
    all_set = F.lit(True)
    for c in rules.critical:
        all_set = all_set & F.col(c).isNotNull()
    holes = F.lit(0)
    for c in fills:
        holes = holes + F.col(c).isNull().cast("int")
    before = standard.agg(
        F.count("*").alias("rows_read"), F.count_if(~all_set).alias("dropped"),
        F.coalesce(F.sum(F.when(all_set, holes)), F.lit(0)).alias("imputed"),
    ).withColumn("_k", F.lit(1))
    kept = impute(drop_incomplete(standard, rules.critical), fills)
    written = deduplicate(kept, rules.row_id, (rules.source,)).agg(F.count("*").alias("written")).withColumn("_k", F.lit(1))
    return before.join(F.broadcast(written), "_k").select(
        "rows_read", "dropped", "imputed",
        (F.col("rows_read") - F.col("dropped") - F.col("written")).alias("duplicates"), "written")


def validate(cleaned: DataFrame, rules: CleaningRules = CleaningRules()) -> None:
    """Raises for unknown labels and for nulls that are left."""
    unknown = {r["label"]: r["count"] for r in unknown_labels(cleaned, rules.label).limit(50).collect()}
    nulls = {r["column"]: r["missing"] for r in missing_counts(cleaned).where("missing > 0").collect()}
    if unknown or nulls:
        raise ValueError(f"cleaning left unknown labels {unknown} and nulls {nulls}")
