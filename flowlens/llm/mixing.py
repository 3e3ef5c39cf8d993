"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Targets. Source number k in the order of names weighs `weights[k mod len(weights)]`; the weights share the total size. A source
gives at most `most_copies` times its size; what that leaves over is shared again by weight among the others until none is above
(water filling: sources in the order of their limit per weight, the first ones at their limit, one level for the rest).

Sampling. A source's rate is its target over its size. Every document is taken whole as often as the rate has ones. The rest of
the rate is the inclusion probability p of one more copy: documents are ranked by the Pareto order (u / (1 - u)) /
(p / (1 - p)) of a random number u that is a hash of the doc_id, and the smallest ranks are taken until their size comes
nearest to what the target still wants. No source is ordered as a whole: the place of the cut is found from totals of
rank buckets, in two rounds of `BUCKETS`, and only one bucket of a bucket is ordered.

Defined results: a null text has size 0; null sources are one source, the last; rows with the same doc_id in a source are
taken together; a source without words has target 0; extra columns stay; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.llm.exchange import give_rest, keep_rest, staged

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
BUCKETS = 4096
MADE = ("size", "source_size", "target", "taken", "copies")


def size_of(text: Column) -> Column:
    """Words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_copies: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target from rows of (source, size)."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(0))
    named = every.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most_copies)
    order = every.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("total", F.sum("source_size").over(every)).withColumn(
        "left", F.col("total") - F.coalesce(F.sum("limit").over(so_far), F.lit(0))).withColumn(
        "against", F.sum("weight").over(onward)).withColumn(
        "full", F.col("left") * F.col("weight") >= F.col("limit") * F.col("against"))
    rest = per.withColumn("level_left", F.max(F.when(~F.col("full"), F.col("left"))).over(every)).withColumn(
        "level_against", F.max(F.when(~F.col("full"), F.col("against"))).over(every))
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(
        F.col("weight") * F.col("level_left").cast("double") / F.col("level_against").cast("double"))
    return rest.select("source", "source_size", target.alias("target"))


def unit(doc_id: Column) -> Column:
    """A number in (0, 1) that follows from the doc_id."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def rank(doc_id: Column, chance: Column) -> Column:
    """Pareto rank for an inclusion probability strictly between 0 and 1."""
    u = unit(doc_id)
    return (u / (1 - u)) / (chance / (1 - chance))


def _digits(place: Column) -> tuple[Column, Column]:
    first = F.floor(place * BUCKETS)
    return first, F.floor((place * BUCKETS - first) * BUCKETS)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_copies: int = MOST_COPIES) -> DataFrame:
    """`docs` with size, source_size, target, taken (words) and copies (times the document is taken)."""
    spark = docs.sparkSession
    kept = keep_rest(docs, "doc_id", "text", "source")
    sized = staged(lambda: docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "mix-sizes", spark)
    targets = source_targets(sized, weights, most_copies).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn(
        "whole", F.floor("rate")).withColumn("chance", F.col("rate") - F.col("whole")).withColumn(
        "wanted", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = staged(lambda: targets.withColumnRenamed("source", "_source"), "mix-targets", spark)

    def with_rank(df):
        ranked = df.join(targets, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
            "rank", F.when(F.col("chance") > 0, rank(F.col("doc_id"), F.col("chance"))))
        first, second = _digits(F.col("rank") / (1 + F.col("rank")))
        return ranked.withColumn("d1", first).withColumn("d2", second)

    def cut(df, digit, base):
        """Of each source, the bucket in which the wanted size is reached, and the size before it."""
        w = Window.partitionBy("_source").orderBy(digit)
        sums = df.groupBy("_source", "wanted", *base, digit).agg(F.sum("size").alias("bucket_size"))
        before = F.col("before") if "before" in base else F.lit(0)
        sums = sums.withColumn("end", before + F.sum("bucket_size").over(w)).withColumn(
            "start", F.col("end") - F.col("bucket_size"))
        return sums.where("start < wanted and wanted <= end").select(
            F.col("_source").alias("_s"), *[c for c in base if c != "before"], digit, F.col("start").alias("before"))

    ranked = with_rank(sized).where("rank is not null")
    one = cut(ranked, "d1", [])
    inside = ranked.join(one.withColumnRenamed("d1", "_d1"), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("d1") == F.col("_d1")))
    two = cut(inside.drop("_s"), "d2", ["d1", "before"])
    last = ranked.join(two.withColumnRenamed("d1", "_d1").withColumnRenamed("d2", "_d2"),
                       F.col("_source").eqNullSafe(F.col("_s")) & (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")))
    alike = last.groupBy("_source", "wanted", "before", "rank", "doc_id").agg(F.sum("size").alias("size"))
    w = Window.partitionBy("_source").orderBy("rank", "doc_id")
    alike = alike.withColumn("end", F.col("before") + F.sum("size").over(w)).where(
        F.col("end") - F.col("size") / 2 <= F.col("wanted"))
    edge = alike.groupBy(F.col("_source").alias("_e")).agg(
        F.max(F.struct("rank", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"))).alias("_edge"))
    # a bucket whose first document is beyond half leaves no edge there: everything before the bucket is taken
    floor_ = two.select(F.col("_s").alias("_f"), F.struct("d1", "d2").alias("_floor"))
    cuts = staged(lambda: targets.join(edge, F.col("_source").eqNullSafe(F.col("_e")), "left").join(
        floor_, F.col("_source").eqNullSafe(F.col("_f")), "left").select(
        "_source", "source_size", "target", "whole", "chance", "_edge", "_floor"), "mix-cuts", spark)

    out = kept.join(cuts, F.col("source").eqNullSafe(F.col("_source"))).withColumn("size", size_of(F.col("text"))).withColumn(
        "rank", F.when(F.col("chance") > 0, rank(F.col("doc_id"), F.col("chance"))))
    first, second = _digits(F.col("rank") / (1 + F.col("rank")))
    before = F.struct(first.alias("d1"), second.alias("d2")) < F.col("_floor")
    within = F.struct(F.col("rank"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id")) <= F.col("_edge")
    more = F.coalesce(before, F.lit(False)) | F.coalesce(within, F.lit(False))
    # no bucket reaches the wanted size only if rounding asks for more than there is: then all are taken
    more = F.when(F.col("rank").isNull(), F.lit(0)).when(F.col("_floor").isNull(), F.lit(1)).otherwise(more.cast("int"))
    out = out.withColumn("copies", F.col("whole") + more).withColumn("taken", F.col("copies") * F.col("size"))
    return give_rest(out.select("doc_id", "text", "source", "_rest", *MADE), *MADE)


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it."""
    found = mix(docs, **options).where("copies > 0")
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(docs.columns)
