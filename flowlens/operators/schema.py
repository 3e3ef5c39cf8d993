"""Column names, schema alignment and types. Header operators work on one row per file and column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from flowlens.functions.columns import column_key, squeeze
from flowlens.operators.ordering import dense_index

NUMERIC_SHARE = 0.99
INT_WIDTHS = ((8, "tinyint"), (16, "smallint"), (32, "int"), (64, "bigint"))


def normalize_headers(headers: DataFrame, raw: str = "raw_name") -> DataFrame:
    return headers.withColumn("name", column_key(raw))


def disambiguate(headers: DataFrame, file: str = "file", pos: str = "pos") -> DataFrame:
    """Unique names: the second and later occurrence in a file gets `__dup1`, `__dup2` and so on."""
    seen = dense_index(headers, [file, "name"], pos, "_seen")
    suffix = F.concat(F.lit("__dup"), (F.col("_seen") - 1).cast("string"))
    return seen.withColumn("column", F.when(F.col("_seen") == 1, F.col("name")).otherwise(F.concat("name", suffix))
                           ).drop("_seen")


def ordered_union(headers: DataFrame, file: str = "file", pos: str = "pos") -> DataFrame:
    """Every column once, with the place where it first appears, in that order."""
    first = headers.groupBy("column").agg(F.min(F.struct(file, pos)).alias("_f"))
    return first.select("column", F.col(f"_f.{file}").alias("first_file"), F.col(f"_f.{pos}").alias("first_pos")
                        ).orderBy("first_file", "first_pos")


def mismatches(headers: DataFrame, file: str = "file") -> DataFrame:
    """(file, column, kind): columns missing from a file, or extra, against the first file.

    The first file's header is one row; every other file is met with that row.
    """
    one = F.lit(1).alias("_k")
    first = headers.agg(F.min(file).alias("_first")).select("_first", one)
    tagged = headers.select(file, "column", one).join(F.broadcast(first), "_k")
    reference = tagged.where(F.col(file) == F.col("_first")).select("column").distinct()
    have = tagged.where(F.col(file) != F.col("_first")).select(file, "column").distinct()
    extra = have.join(reference, "column", "left_anti").withColumn("kind", F.lit("extra"))
    wanted = reference.agg(F.collect_list("column").alias("_cols")).select("_cols", one)
    expected = have.select(file).distinct().select(file, one).join(F.broadcast(wanted), "_k").select(
        file, F.explode("_cols").alias("column"))
    missing = expected.join(have, [file, "column"], "left_anti").withColumn("kind", F.lit("missing"))
    return missing.unionByName(extra)


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of the schema in its order: missing ones null, others dropped."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def text_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, values, numbers, is_numeric: text is numeric when 99 % of what is there parses."""
    aggs = []
    for i, c in enumerate(columns):
        value = squeeze(c)
        aggs += [F.count(value).alias(f"_v{i}"), F.count(value.try_cast("double")).alias(f"_n{i}")]
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_v{i}").alias("values"), F.col(f"_n{i}").alias("numbers"))
        for i, c in enumerate(columns)])
    out = df.agg(*aggs).select(F.inline(cells))
    return out.withColumn("is_numeric", (F.col("values") > 0) & (F.col("numbers") >= NUMERIC_SHARE * F.col("values")))


def infer_numbers(df: DataFrame, protected: Sequence[str] = ("label", "source_file")) -> DataFrame:
    """Casts the text columns that are numeric by `text_profile`, decided over the whole table."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in protected]
    if not names:
        return df
    numeric = [r["column"] for r in text_profile(df, names).where("is_numeric").collect()]
    return df.withColumns({c: squeeze(c).try_cast("double") for c in numeric}) if numeric else df


def width_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, low, high, width: the smallest integer type that holds the column."""
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.min(c).cast("bigint").alias(f"_l{i}"), F.max(c).cast("bigint").alias(f"_h{i}")]
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_l{i}").alias("low"), F.col(f"_h{i}").alias("high"))
        for i, c in enumerate(columns)])
    width = F.lit("bigint")
    for bits, name in reversed(INT_WIDTHS[:-1]):
        fits = (F.col("low") >= -(2 ** (bits - 1))) & (F.col("high") <= 2 ** (bits - 1) - 1)
        width = F.when(fits, name).otherwise(width)
    return df.agg(*aggs).select(F.inline(cells)).withColumn("width", width)


def narrow(df: DataFrame, protected: Sequence[str] = ("label", "source_file", "row_id")) -> DataFrame:
    """Casts integer columns to their width and protected columns, but for the row id, to text."""
    integral = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    names = [f.name for f in df.schema if isinstance(f.dataType, integral) and f.name not in protected]
    widths = {r["column"]: r["width"] for r in width_profile(df, names).collect()} if names else {}
    texts = {c: F.col(c).cast("string") for c in protected if c in df.columns and c != "row_id"}
    return df.withColumns({**{c: F.col(c).cast(w) for c, w in widths.items()}, **texts})
