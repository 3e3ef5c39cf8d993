"""Feature selection: correlation filter, mutual information, recursive elimination, principal components."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import PCA
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.functions.local import local_table
from flowlens.operators.ordering import BLOCK_ROWS, value_prefix
from flowlens.operators.transform import assemble, fit_scaler, scale
from flowlens.session import cut_lineage

CORRELATION_LIMIT = 0.98
BINS = 10
NEIGHBORS = 3
TOP_INFORMATION = 60
KEEP_FEATURES = 30
DROP_SHARE = 0.2
VARIANCE = 0.95


def correlations(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(i, j, left, right, r): absolute Pearson correlation of every two features; null for a constant one.

    One pass builds the moment matrix; only its features x features cells reach the driver.
    """
    names = list(features)
    matrix = Correlation.corr(assemble(df.select(*names), names), "features").first()[0].toArray()
    rows = [(i, j, names[i], names[j], None if math.isnan(matrix[i, j]) else float(abs(matrix[i, j])))
            for i in range(len(names)) for j in range(i + 1, len(names))]
    return local_table(df.sparkSession, rows, "i int, j int, left string, right string, r double")


def correlation_filter(matrix: DataFrame, limit: float = CORRELATION_LIMIT) -> DataFrame:
    """Dropped features, each with the earlier features it goes with (dropped ones count too)."""
    hits = matrix.where(F.col("r") > limit).groupBy("j", F.col("right").alias("feature")).agg(
        F.sort_array(F.collect_list(F.struct("i", "left"))).alias("_w"))
    return hits.select("feature", F.transform("_w", lambda w: w["left"]).alias("correlated_with"))


def kept_features(features: Sequence[str], dropped: DataFrame) -> list[str]:
    gone = {r["feature"] for r in dropped.select("feature").collect()}
    return [f for f in features if f not in gone]


def mutual_information(df: DataFrame, features: Sequence[str], target: str, bins: int = BINS) -> DataFrame:
    """feature, score in nats, from equal-frequency bins. Equal values share a bin.

    A plainer form of `neighbour_information`. Values are counted per class before anything is ranked, so repeated values cost nothing.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    cell_counts = df.select(F.col(target).alias("c"), F.inline(cells)).groupBy("feature", "value", "c").agg(
        F.count("*").alias("n"))
    values = cell_counts.groupBy("feature", "value").agg(F.sum("n").alias("m"))
    ranked = value_prefix(values, ["feature"], "value", ["m"])
    k = F.lit(1).alias("_k")
    size = df.agg(F.count("*").alias("_all")).select("*", k)
    binned = ranked.select("*", k).join(F.broadcast(size), "_k").select(
        "feature", "value", F.floor(F.col("m_lt") * bins / F.col("_all")).alias("b"))
    joint = cell_counts.join(binned, ["feature", "value"]).groupBy("feature", "b", "c").agg(F.sum("n").alias("n"))
    by_bin = joint.groupBy("feature", "b").agg(F.sum("n").alias("nb"))
    by_class = joint.groupBy("feature", "c").agg(F.sum("n").alias("nc"))
    full = joint.join(by_bin, ["feature", "b"]).join(by_class, ["feature", "c"]).select("*", k).join(F.broadcast(size), "_k")
    term = F.col("n") / F.col("_all") * F.log(
        F.col("n").cast("double") * F.col("_all") / (F.col("nb").cast("double") * F.col("nc")))
    return full.groupBy("feature").agg(F.sum(term).alias("score"))


def digamma(n: Column) -> Column:
    """Logarithmic derivative of the gamma function at a positive number, by its expansion at n + 6."""
    x = n.cast("double") + 6.0
    ahead = F.log(x) - 0.5 / x - 1.0 / (12.0 * x * x) + 1.0 / (120.0 * F.pow(x, F.lit(4.0))) - 1.0 / (252.0 * F.pow(x, F.lit(6.0)))
    for i in range(6):
        ahead = ahead - 1.0 / (n.cast("double") + float(i))
    return ahead


def _reach(rows: DataFrame, neighbors: int, block_rows: int) -> DataFrame:
    """`radius`: distance of each value to the `neighbors`-th other row of its class. `rows`: feature, c, value, n (rows of the class
    with the value), nc (rows of the class), place (number of the value in its class).

    A class is cut into blocks of values; a block also sees the values next to it.
    """
    at, width = F.col("place") % block_rows, F.lit(block_rows)
    block = F.floor(F.col("place") / width)
    sides = F.array_compact(F.array(F.lit(0), F.when(at < neighbors, F.lit(-1)), F.when(at >= block_rows - neighbors, F.lit(1))))
    seen = rows.withColumn("_side", F.explode(sides)).withColumn("_block", block + F.col("_side"))
    order = Window.partitionBy("feature", "c", "_block").orderBy("value")
    others = [F.when(side("value", i).over(order).isNotNull(), F.struct(
        F.abs(side("value", i).over(order) - F.col("value")).alias("d"), side("n", i).over(order).alias("n")))
        for i in range(1, neighbors + 1) for side in (F.lag, F.lead)]
    wanted = F.least(F.lit(neighbors), F.col("nc") - 1) - (F.col("n") - 1)
    near = seen.withColumn("_others", F.sort_array(F.array_compact(F.array(*others)))).where("_side = 0")
    # the nearest values in turn, until they hold as many rows as are wanted
    found = F.aggregate(
        "_others", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("d")),
        lambda a, o: F.when(a["n"] < wanted, F.struct((a["n"] + o["n"]).alias("n"), o["d"].alias("d"))).otherwise(a), lambda a: a["d"])
    return near.withColumn("radius", F.when(wanted <= 0, 0.0).otherwise(found)).drop("_side", "_block", "_others")


def neighbour_information(df: DataFrame, features: Sequence[str], target: str, neighbors: int = NEIGHBORS,
                          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """feature, score in nats: the estimate by nearest neighbours for a number and a class.

    Around each row lies the distance to its `neighbors`-th neighbour of the same class; the more rows of any class lie closer than that,
    the less the number tells. Equal numbers are counted first. The rows closer are a difference of two ranks: the ends of all
    distances are ranked among the numbers in one pass. Missing numbers and classes of one row are left out.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    rows = df.where(F.col(target).isNotNull()).select(F.col(target).alias("c"), F.inline(cells)).where("value is not null")
    counts = rows.groupBy("feature", "c", "value").agg(F.count("*").alias("n"), F.lit(1).alias("one"))
    classes = counts.groupBy("feature", "c").agg(F.sum("n").alias("nc")).where("nc > 1")
    counts = counts.join(F.broadcast(classes), ["feature", "c"])  # one row per feature and class
    placed = value_prefix(counts, ["feature", "c"], "value", ["one"]).withColumnRenamed("one_lt", "place").drop("one")
    asked = cut_lineage(_reach(placed, neighbors, block_rows).withColumns({
        "low": F.col("value") - F.col("radius"), "high": F.col("value") + F.col("radius")}))
    points = asked.select("feature", "value", F.col("n").alias("m"))
    for end in ("low", "high"):
        points = points.unionByName(asked.where("radius > 0").select("feature", F.col(end).alias("value"), F.lit(0).cast("long").alias("m")))
    ranked = cut_lineage(value_prefix(points.groupBy("feature", "value").agg(F.sum("m").alias("m")), ["feature"], "value", ["m"]))
    own = ranked.select("feature", "value", F.col("m").alias("_same"))
    below = ranked.select("feature", F.col("value").alias("low"), (F.col("m_lt") + F.col("m")).alias("_below"))
    above = ranked.select("feature", F.col("value").alias("high"), F.col("m_lt").alias("_above"))
    met = asked.join(own, ["feature", "value"]).join(below, ["feature", "low"], "left").join(above, ["feature", "high"], "left")
    closer = F.when(F.col("radius") > 0, F.col("_above") - F.col("_below")).otherwise(F.col("_same"))
    told = digamma(F.least(F.lit(neighbors), F.col("nc") - 1)) - digamma(F.col("nc")) - digamma(closer)
    return met.groupBy("feature").agg(F.sum(told * F.col("n")).alias("_sum"), F.sum("n").alias("_n")).select(
        "feature", F.greatest(digamma(F.col("_n")) + F.col("_sum") / F.col("_n"), F.lit(0.0)).alias("score"))


def top_information(scores: DataFrame, features: Sequence[str], k: int = TOP_INFORMATION) -> list[str]:
    """The k highest scores; equal scores keep the order of the features."""
    score = {r["feature"]: r["score"] for r in scores.collect()}
    return sorted(features, key=lambda f: -score[f])[:k]


def eliminate(
    sample: DataFrame, features: Sequence[str], target: str, keep: int = KEEP_FEATURES,
    drop_share: float = DROP_SHARE, max_iter: int = 20, reg: float = 1e-3,
) -> DataFrame:
    """feature, ranking, selected: rounds of a linear support vector machine, each dropping the weakest.

    A fixed share of the first feature count leaves per round; the last ones out rank 2, the kept ones 1.
    The loop is on the driver, each fit is distributed. Give it a sample.
    """
    names = list(features)
    sample = sample.select(*[F.col(f).cast("double").alias(f) for f in names], F.col(target).cast("int").alias("_y")).persist()
    try:
        scaled = scale(sample, fit_scaler(sample, names)).persist()
        step = max(1, int(drop_share * len(names)))
        left, out = list(names), []
        while len(left) > keep:
            data = assemble(scaled, left)
            model = OneVsRest(classifier=LinearSVC(maxIter=max_iter, regParam=reg), labelCol="_y",
                              featuresCol="features", parallelism=4).fit(data)
            weight = sum(m.coefficients.toArray() ** 2 for m in model.models)
            order = sorted(range(len(left)), key=lambda i: (weight[i], i))
            gone = [left[i] for i in order[: min(step, len(left) - keep)]]
            out.append(gone)
            left = [f for f in left if f not in gone]
        scaled.unpersist()
    finally:
        sample.unpersist()
    rank = {f: 1 for f in left}
    for n, gone in enumerate(reversed(out)):
        rank |= {f: n + 2 for f in gone}
    return local_table(sample.sparkSession, [(f, rank[f], rank[f] == 1) for f in names], "feature string, ranking int, selected boolean")


def principal_components(df: DataFrame, features: Sequence[str], variance: float = VARIANCE) -> DataFrame:
    """component, variance_ratio, cumulative, needed: the components that reach the wanted variance."""
    names = list(features)
    scaled = assemble(scale(df, fit_scaler(df, names)), names)
    ratios = PCA(k=len(names), inputCol="features", outputCol="_pc").fit(scaled).explainedVariance.toArray()
    rows, total = [], 0.0
    for i, r in enumerate(ratios):
        rows.append((i + 1, float(r), float(total + r), bool(total < variance)))
        total += r
    return local_table(df.sparkSession, rows, "component int, variance_ratio double, cumulative double, needed boolean")
