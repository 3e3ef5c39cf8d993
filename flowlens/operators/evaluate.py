"""Classification and anomaly metrics from one grouped pass over the predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.functions.local import local_table
from flowlens.operators.ordering import value_prefix

ROC_POINTS = 400


def ratio(n: Column, d: Column) -> Column:
    """Zero on an empty denominator."""
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def _harmonic(p: Column, r: Column) -> Column:
    return ratio(F.lit(2.0) * p * r, p + r)


def binary_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: the four cells and accuracy, precision, recall, f1_score."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    cells = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
                   F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = cells.withColumns({"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp),
                             "recall": ratio(tp, tp + fn)})
    return out.withColumn("f1_score", _harmonic(F.col("precision"), F.col("recall")))


def class_report(df: DataFrame, truth: str, predicted: str, labels: Sequence) -> DataFrame:
    """label, precision, recall, f1_score, support for each listed label and for the two averages."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = F.array(
        F.struct(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("hits")),
    )
    sums = pairs.select(F.inline(sides)).groupBy("label").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    kind = df.schema[truth].dataType.simpleString()
    listed = local_table(df.sparkSession, [(v,) for v in labels], f"label {kind}")
    per = listed.join(sums, "label", "left").fillna(0, ["support", "predicted", "hits"])
    per = per.withColumns({"precision": ratio(F.col("hits"), F.col("predicted")),
                           "recall": ratio(F.col("hits"), F.col("support"))})
    per = per.withColumn("f1_score", _harmonic(F.col("precision"), F.col("recall")))
    names = ("precision", "recall", "f1_score")
    rows = per.select(F.col("label").cast("string").alias("label"), *names, "support")
    whole = F.sum("support")
    averages = rows.agg(
        whole.alias("support"), *[F.avg(c).alias(f"m_{c}") for c in names],
        *[ratio(F.sum(F.col(c) * F.col("support")), whole).alias(f"w_{c}") for c in names],
    ).select(F.inline(F.array(*[
        F.struct(F.lit(label).alias("label"), *[F.col(f"{k}_{c}").alias(c) for c in names], F.col("support"))
        for label, k in (("macro avg", "m"), ("weighted avg", "w"))])))
    return rows.unionByName(averages)


def multiclass_metrics(df: DataFrame, truth: str, predicted: str, labels: Sequence) -> DataFrame:
    """One row: accuracy and support-weighted precision, recall, f1_score."""
    weighted = class_report(df, truth, predicted, labels).where("label = 'weighted avg'")
    right = df.agg(ratio(F.count_if(F.col(truth) == F.col(predicted)), F.count("*")).alias("accuracy"))
    one = F.lit(1).alias("_k")
    return right.select("accuracy", one).join(
        F.broadcast(weighted.select("precision", "recall", "f1_score", one)), "_k").drop("_k")


def roc_auc(df: DataFrame, truth: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve per key, tied scores counted half; null where one class is missing.

    Rows meet by score first; the sorted sums run in score buckets, so neither a frequent score nor a
    crowded score range ends in one task.
    """
    t = F.col(truth) == 1
    counted = df.groupBy(*keys, score).agg(F.count_if(t).alias("pos"), F.count_if(~t).alias("neg"))
    ranked = value_prefix(counted, keys, score, ["neg"])
    wins = F.col("pos").cast("double") * (F.col("neg_lt") + F.col("neg") / F.lit(2.0))
    return ranked.groupBy(*keys).agg(
        F.sum(wins).alias("_w"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives")
    ).select(*keys, "positives", "negatives", F.when(
        (F.col("positives") > 0) & (F.col("negatives") > 0),
        F.col("_w") / (F.col("positives").cast("double") * F.col("negatives"))).alias("roc_auc"))


def multiclass_auc(df: DataFrame, truth: str, probabilities: str, labels: Sequence[int]) -> DataFrame:
    """One-vs-rest areas weighted by support. `probabilities` is an array in the order of the labels."""
    cells = F.array(*[
        F.struct(F.lit(label).alias("class_id"), F.col(probabilities)[i].alias("score"),
                 (F.col(truth) == label).cast("int").alias("hit")) for i, label in enumerate(labels)])
    per = roc_auc(df.select(F.inline(cells)), "hit", "score", ["class_id"])
    return per.agg((F.sum(F.col("roc_auc") * F.col("positives")) / F.sum("positives")).alias("roc_auc"))


def min_max(df: DataFrame, score: str, out: str = "scaled") -> DataFrame:
    """Scores stretched to 0..1; all zero when they are equal."""
    k = F.lit(1).alias("_k")
    ends = df.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi")).select("*", k)
    width = F.col("_hi") - F.col("_lo")
    scaled = F.when(width > 0, (F.col(score) - F.col("_lo")) / width).otherwise(0.0)
    return df.select("*", k).join(F.broadcast(ends), "_k").withColumn(out, scaled).drop("_k", "_lo", "_hi")


def roc_curve(df: DataFrame, truth: str, score: str, points: int = ROC_POINTS) -> DataFrame:
    """At most `points` thresholds with their rates, evenly spread over the distinct scores.

    The point before the highest score has the threshold infinity, given as null.
    """
    t = F.col(truth) == 1
    counted = df.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(t).alias("pos"), F.count_if(~t).alias("neg"), F.lit(1).cast("bigint").alias("one"))
    k = F.lit(1).alias("_k")
    totals = counted.agg(*[F.sum(c).alias(f"_{c}") for c in ("pos", "neg", "one")]).select("*", k)
    ranked = value_prefix(counted, [], "threshold", ["pos", "neg", "one"]).select("*", k)
    all_points = ranked.join(F.broadcast(totals), "_k").select(
        (F.col("_one") - F.col("one_lt")).alias("point"), "threshold", "_one",
        ((F.col("_pos") - F.col("pos_lt")) / F.col("_pos")).alias("true_positive_rate"),
        ((F.col("_neg") - F.col("neg_lt")) / F.col("_neg")).alias("false_positive_rate"),
    ).unionByName(totals.select(
        F.lit(0).cast("bigint").alias("point"), F.lit(None).cast("double").alias("threshold"), "_one",
        F.lit(0.0).alias("true_positive_rate"), F.lit(0.0).alias("false_positive_rate")))
    last, steps = F.col("_one"), points - 1
    nth = F.floor((F.col("point") * steps + last - 1) / last)
    kept = (last < points) | (F.floor(nth * last / steps) == F.col("point"))
    return all_points.where(kept).select("point", "threshold", "true_positive_rate", "false_positive_rate")


def anomaly_metrics(df: DataFrame, truth: str, score: str, threshold: float) -> DataFrame:
    """Metrics of the flag score >= threshold with area and score range. One row."""
    flagged = df.withColumn("_flag", (F.col(score) >= threshold).cast("int"))
    k = F.lit(1).alias("_k")
    ends = df.agg(F.min(score).alias("score_min"), F.max(score).alias("score_max")).select("*", k)
    area = roc_auc(df, truth, score).select("roc_auc", k)
    cells = binary_metrics(flagged, truth, "_flag").select("*", k)
    return cells.join(F.broadcast(ends), "_k").join(F.broadcast(area), "_k").drop("_k").withColumn(
        "threshold", F.lit(float(threshold)))
