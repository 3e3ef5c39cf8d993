"""Feature statistics, drift between two tables, retraining recommendation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

DRIFT_Z = 2.5
TOP_DRIFT = 15

# Trigger names and thresholds, actions and the phases each trigger asks to repeat.
TRIGGERS = (
    ("zero_day_candidate_rows", 250,
     "Review the novelty queue, validate analyst labels, and expand the attack taxonomy where needed.",
     (7, 8, 9, 10, 11, 12)),
    ("continuous_learning_queue_rows", 1500,
     "Refresh supervised classifiers with the latest analyst-reviewed edge cases near the decision boundary.",
     (6, 7, 9, 10, 11, 12)),
    ("drifted_feature_count", 5,
     "Recompute preprocessing and feature-engineering baselines before retraining downstream detectors.",
     (4, 5, 6, 7, 8, 9, 10, 11, 12)),
)


def feature_stats(
    df: DataFrame, features: Sequence[str], prefix: str = "feature", keys: Sequence[str] = ()
) -> DataFrame:
    """feature_name, mean, population std and rows; what is missing or not finite counts as zero.

    One aggregate over all columns, then its row per key is turned: the table is never exploded.
    """
    def value(name):
        x = F.col(name).cast("double")
        return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)

    aggs = [F.count("*").alias("_rows")]
    for i, name in enumerate(features):
        aggs += [F.avg(value(name)).alias(f"_m{i}"), F.stddev_pop(value(name)).alias(f"_s{i}")]
    cells = F.array(*[
        F.struct(F.lit(name).alias("feature_name"), F.col(f"_m{i}").alias(f"{prefix}_mean"),
                 F.col(f"_s{i}").alias(f"{prefix}_std"), F.col("_rows").alias(f"{prefix}_rows"))
        for i, name in enumerate(features)
    ])
    return df.groupBy(*keys).agg(*aggs).select(*keys, F.inline(cells))


def moments(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mergeable partial statistics (rows, sum, sum of squares) per key and feature."""
    aggs = [F.count("*").alias("_rows")]
    for i, name in enumerate(features):
        x = F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(0.0)), F.lit(0.0))
        aggs += [F.sum(x).alias(f"_a{i}"), F.sum(x * x).alias(f"_b{i}")]
    cells = F.array(*[
        F.struct(F.lit(name).alias("feature_name"), F.col("_rows").alias("rows"),
                 F.col(f"_a{i}").alias("total"), F.col(f"_b{i}").alias("squares"))
        for i, name in enumerate(features)
    ])
    return df.groupBy(*keys).agg(*aggs).select(*keys, F.inline(cells))


def drift(reference: DataFrame, stream: DataFrame, z_limit: float = DRIFT_Z) -> DataFrame:
    """Shift of the means in units of the reference deviation, one row per feature."""
    shift = F.abs(F.col("stream_mean") - F.col("reference_mean"))
    return (
        reference.join(stream, "feature_name")
        .withColumn("absolute_mean_shift", shift)
        .withColumn("z_shift", F.col("absolute_mean_shift") / F.greatest("reference_std", F.lit(1e-6)))
        .withColumn("drifted", F.col("z_shift") >= z_limit)
    )


def split_drift(df: DataFrame, features: Sequence[str], flag: str = "is_test", z_limit: float = DRIFT_Z) -> DataFrame:
    """Drift of the flagged rows against the others, in one pass over the table."""
    stats = feature_stats(df, features, "x", [flag])

    def side(flagged: bool, prefix: str) -> DataFrame:
        rows = stats.where(F.col(flag) == flagged)
        return rows.select("feature_name", *[F.col(f"x_{n}").alias(f"{prefix}_{n}") for n in ("mean", "std", "rows")])

    return drift(side(False, "reference"), side(True, "stream"), z_limit)


def top_drift(drifted: DataFrame, n: int = TOP_DRIFT) -> DataFrame:
    return drifted.orderBy(F.desc("drifted"), F.desc("z_shift"), "feature_name").limit(n)


def retraining(counts: DataFrame) -> DataFrame:
    """One row of counts, named as the triggers, to reasons, actions and phases."""
    none = F.array().cast("array<int>")
    fired = [F.col(name) >= limit for name, limit, _, _ in TRIGGERS]
    reasons = F.array_compact(F.array(*[
        F.when(on, f"{name}>={limit}") for on, (name, limit, _, _) in zip(fired, TRIGGERS)]))
    actions = F.array_compact(F.array(*[F.when(on, F.lit(act)) for on, (_, _, act, _) in zip(fired, TRIGGERS)]))
    phases = F.concat(*[
        F.when(on, F.array(*[F.lit(p) for p in ps])).otherwise(none) for on, (_, _, _, ps) in zip(fired, TRIGGERS)])
    return counts.select(
        *[name for name, *_ in TRIGGERS],
        (F.size(reasons) > 0).alias("retraining_recommended"),
        reasons.alias("retraining_reasons"), actions.alias("recommended_actions"),
        F.array_sort(F.array_distinct(phases)).alias("recommended_phases"),
    )
