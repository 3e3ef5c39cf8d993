"""Scaling, encoding and assembly, fitted on the training rows only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

MISSING = "__missing__"
MAX_CATEGORIES = 10_000


def fit_scaler(train: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per feature; a deviation of zero becomes one."""
    aggs = []
    for i, c in enumerate(features):
        aggs += [F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}")]
    row = train.agg(*aggs).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(features)}


def scale(df: DataFrame, scaler: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scaler.items()})


def fit_categories(train: DataFrame, column: str) -> list[str]:
    """Sorted categories seen in training; null counts as a category of its own."""
    found = train.select(F.coalesce(F.col(column).cast("string"), F.lit(MISSING)).alias("v")).distinct()
    rows = found.limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"{column} has more than {MAX_CATEGORIES} categories")
    return sorted(r["v"] for r in rows)


def one_hot(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """Columns `<column>_<category>`; an unseen category is zero everywhere."""
    value = F.coalesce(F.col(column).cast("string"), F.lit(MISSING))
    return df.withColumns({f"{column}_{c}": F.when(value == c, 1.0).otherwise(0.0) for c in categories})


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    plain = df.withColumns({c: F.col(c).cast("double") for c in features})
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(plain)


def preprocessing_report(df: DataFrame, flag: str, target: str, features: Sequence[str]) -> DataFrame:
    """Rows per split and class, with the rows that hold a missing or not finite feature."""
    bad = F.lit(False)
    for c in features:
        x = F.col(c).cast("double")
        bad = bad | x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    split = F.when(F.col(flag), "test").otherwise("train")
    return df.groupBy(split.alias("split"), F.col(target).alias("class_id")).agg(
        F.count("*").alias("rows"), F.count_if(bad).alias("invalid_rows"))
