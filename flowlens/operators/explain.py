"""Contribution tables: what features and components add to a prediction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.operators.ensemble import normalize

TOP_FEATURES = 8


def global_summary(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature_name, mean_abs_contribution, mean_contribution over a wide contribution table. One aggregate."""
    aggs = []
    for i, name in enumerate(features):
        aggs += [F.avg(F.abs(name)).alias(f"_a{i}"), F.avg(name).alias(f"_m{i}")]
    cells = F.array(*[
        F.struct(F.lit(name).alias("feature_name"), F.col(f"_a{i}").alias("mean_abs_contribution"),
                 F.col(f"_m{i}").alias("mean_contribution")) for i, name in enumerate(features)])
    out = df.agg(*aggs).select(F.inline(cells))
    return out.orderBy(F.desc("mean_abs_contribution"), "feature_name")


def top_contributions(df: DataFrame, features: Sequence[str], keep: Sequence[str], k: int = TOP_FEATURES) -> DataFrame:
    """The k largest contributions of each row, with their rank. Sorted inside the row: no shuffle."""
    k = min(max(k, 1), len(features))
    cells = F.array(*[
        F.struct((-F.abs(name)).alias("order"), F.lit(i).alias("at"), F.lit(name).alias("feature_name"),
                 F.col(name).alias("contribution")) for i, name in enumerate(features)])
    best = F.slice(F.array_sort(cells), 1, k)
    return df.select(*keep, F.posexplode(best).alias("_p", "_c")).select(
        *keep, (F.col("_p") + 1).alias("rank"), "_c.feature_name", "_c.contribution",
        F.abs("_c.contribution").alias("abs_contribution"))


def _means(df: DataFrame, columns: Mapping[str, Column]) -> dict[str, float]:
    """Averages of a few expressions, on the driver."""
    return df.agg(*[F.avg(e).alias(n) for n, e in columns.items()]).first().asDict()


def voting_binary(df: DataFrame, background: DataFrame, components: Sequence[str], weights: Mapping[str, float]) -> DataFrame:
    """Component contributions to the attack probability, with base and explained value."""
    raw = {n: max(0.0, weights[n]) for n in components}
    total = sum(raw.values()) or 1.0
    shares = {n: w / total for n, w in raw.items()}
    base = _means(background, {n: F.col(n) for n in components})
    parts = {f"contribution_{n}": F.lit(shares[n]) * (F.col(n) - F.lit(base[n])) for n in components}
    base_value = sum(shares[n] * base[n] for n in components)
    out = df.withColumns(parts).withColumn("base_value", F.lit(base_value))
    explained = F.col("base_value")
    for name in parts:
        explained = explained + F.col(name)
    return out.withColumn("explained_value", explained).withColumn(
        "predicted_label", (F.col("explained_value") >= 0.5).cast("int"))


def voting_multiclass(
    df: DataFrame, background: DataFrame, components: Sequence[str], weights: Mapping[str, float], combined: str,
    classes: int,
) -> DataFrame:
    """As above for array columns, on the class with the highest combined probability."""
    shares = normalize({n: weights[n] for n in components})
    base = _means(background, {f"{n}_{i}": F.col(n)[i] for n in components for i in range(classes)})
    at = F.array_position(combined, F.array_max(combined)).cast("int")
    out = df.withColumn("_at", at)
    parts, base_value = {}, F.lit(0.0)
    for n in components:
        means = F.element_at(F.array(*[F.lit(base[f"{n}_{i}"]) for i in range(classes)]), F.col("_at"))
        parts[f"contribution_{n}"] = F.lit(shares[n]) * (F.element_at(n, F.col("_at")) - means)
        base_value = base_value + F.lit(shares[n]) * means
    return out.withColumns(parts).withColumns({
        "base_value": base_value, "explained_value": F.element_at(combined, F.col("_at")),
        "predicted_class": F.col("_at") - 1}).drop("_at")


def stacking_binary(
    df: DataFrame, background: DataFrame, components: Sequence[str], coefficients: Sequence[float], intercept: float
) -> DataFrame:
    """Contributions to the logit of a linear combiner over attack probabilities."""
    base = _means(background, {n: F.col(n) for n in components})
    coef = dict(zip(components, coefficients))
    parts = {f"contribution_{n}": F.lit(coef[n]) * (F.col(n) - F.lit(base[n])) for n in components}
    value = F.lit(float(intercept))
    for n in components:
        value = value + F.lit(coef[n]) * F.col(n)
    base_value = intercept + sum(coef[n] * base[n] for n in components)
    return df.withColumns(parts).withColumns({
        "base_value": F.lit(base_value), "explained_value": value, "predicted_label": (value > 0).cast("int")})


def stacking_multiclass(
    df: DataFrame, background: DataFrame, components: Sequence[str], scalars: Sequence[str], classes: int,
    coefficients: Sequence[Sequence[float]], intercepts: Sequence[float],
) -> DataFrame:
    """Contributions to the score of the predicted class; the class vector of a component folds to one number.

    A row of `coefficients` belongs to one class and runs over the components' classes, then the scalars.
    """
    inputs = [(n, i) for n in components for i in range(classes)] + [(n, None) for n in scalars]
    cell = {(n, i): F.col(n) if i is None else F.col(n)[i] for n, i in inputs}
    base = _means(background, {f"{n}#{i}": cell[n, i] for n, i in inputs})
    scores = []
    for row, b in zip(coefficients, intercepts):
        s = F.lit(float(b))
        for w, key in zip(row, inputs):
            s = s + F.lit(float(w)) * cell[key]
        scores.append(s)
    out = df.withColumn("_scores", F.array(*scores))
    out = out.withColumn("_at", F.array_position("_scores", F.array_max("_scores")).cast("int"))

    def chosen(values):
        return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("_at"))

    parts: dict[str, Column] = {}
    base_value = chosen(intercepts)
    for j, (n, i) in enumerate(inputs):
        mean = base[f"{n}#{i}"]
        weight = chosen([row[j] for row in coefficients])
        parts[n] = parts.get(n, F.lit(0.0)) + weight * (cell[n, i] - F.lit(mean))
        base_value = base_value + weight * F.lit(mean)
    return out.withColumns({f"contribution_{n}": e for n, e in parts.items()}).withColumns({
        "base_value": base_value, "explained_value": F.element_at("_scores", F.col("_at")),
        "predicted_class": F.col("_at") - 1}).drop("_at", "_scores")


def run_summary(tables: Mapping[tuple[str, str, str], DataFrame]) -> DataFrame:
    """scope, task, kind, rows, status: one row for each output table."""
    out = None
    for (scope, task, kind), df in tables.items():
        row = df.agg(F.count("*").alias("rows")).select(
            F.lit(scope).alias("scope"), F.lit(task).alias("task"), F.lit(kind).alias("kind"), "rows",
            F.when(F.col("rows") > 0, "written").otherwise("empty").alias("status"))
        out = row if out is None else out.unionByName(row)
    return out
