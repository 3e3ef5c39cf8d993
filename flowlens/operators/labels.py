"""Label canonicalisation and targets."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from flowlens.functions.columns import clean_label, label_key, squeeze
from flowlens.functions.vocab import PUBLISHED, Vocabulary
from flowlens.operators.ordering import broadcast_if_small


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def canonical_expr(df: DataFrame, raw: str, out: str, known: Vocabulary = PUBLISHED) -> DataFrame:
    """Canonical label of a text column; no match keeps the cleaned text, blank is null."""
    dim = known.alias_dim(df.sparkSession).select("alias_key", F.col("label").alias("_known"))
    keyed = df.withColumn("_text", squeeze(raw)).withColumn("_key", label_key("_text"))
    joined = keyed.join(F.broadcast(dim), F.col("_key") == F.col("alias_key"), "left")
    chosen = F.coalesce("_known", clean_label("_text"))
    keep = [c for c in df.columns if c != out]
    return joined.withColumn("_out", chosen).select(*keep, F.col("_out").alias(out))


def canonicalize(df: DataFrame, raw: str = "label", out: str = "label", compatibility_forms: bool = True,
                 known: Vocabulary = PUBLISHED) -> DataFrame:
    """As above, folding Unicode compatibility forms first.

    The folding has no built-in function. It runs once per distinct label, never per row.
    """
    if not compatibility_forms:
        return canonical_expr(df, raw, out, known)
    distinct = df.select(F.col(raw).alias("_raw")).where(F.col(raw).isNotNull()).distinct()
    mapping = canonical_expr(distinct.withColumn("_folded", nfkc("_raw")), "_folded", "_label", known).select("_raw", "_label")
    joined = df.join(broadcast_if_small(mapping), df[raw] == F.col("_raw"), "left")
    keep = [df[c] for c in df.columns if c != out]
    return joined.select(*keep, F.col("_label").alias(out))


def unknown_labels(df: DataFrame, label: str = "label", known: Vocabulary = PUBLISHED) -> DataFrame:
    """Labels outside the vocabulary with their row counts."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("count"))
    return counts.join(F.broadcast(known.label_dim(df.sparkSession)), "label", "left_anti")


def add_targets(df: DataFrame, label: str = "label", known: Vocabulary = PUBLISHED) -> DataFrame:
    """label_binary and label_multiclass; null where the label is unknown."""
    dim = known.label_dim(df.sparkSession)
    return df.join(F.broadcast(dim.withColumnRenamed("label", "_l")), F.col(label) == F.col("_l"), "left").drop("_l")


def check_labels(df: DataFrame, label: str = "label", known: Vocabulary = PUBLISHED) -> None:
    """Raises for missing or unknown labels, so that nothing is written for them; names the most frequent and counts them all."""
    targets = add_targets(df.select(label), label, known)
    wrong = targets.groupBy(label).agg(F.count("*").alias("n"), F.max("label_multiclass").alias("m")).where("m is null")
    every = Window.partitionBy(F.lit(0))  # one row per label that is not known
    wrong = wrong.withColumns({"_rows": F.sum("n").over(every), "_labels": F.count("*").over(every)})
    rows = wrong.orderBy(F.col("n").desc(), F.col(label)).limit(50).collect()
    if rows:
        bad = {r[label]: r["n"] for r in rows}
        raise ValueError(f"{rows[0]['_rows']} rows with {rows[0]['_labels']} missing or unknown labels, the most frequent: {bad}")


def label_rows(df: DataFrame, raw: str = "label", known: Vocabulary = PUBLISHED) -> DataFrame:
    """Canonical label and targets of a cleaned table; fails on labels outside the vocabulary."""
    labelled = canonicalize(df, raw, known=known)
    check_labels(labelled, known=known)
    return add_targets(labelled, known=known)


def target_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("label", "label_binary", "label_multiclass").agg(F.count("*").alias("count"))


def target_check(df: DataFrame, known: Vocabulary = PUBLISHED) -> DataFrame:
    """One row of the sums that must agree."""
    benign = F.col("label") == known.benign
    return df.agg(
        F.count("*").alias("rows"), F.count_if(benign).alias("benign_rows"),
        F.count_if(F.col("label_binary") == 0).alias("binary_zero"),
        F.count_if(F.col("label_multiclass") == known.labels.index(known.benign)).alias("multiclass_zero"),
        F.count_if(F.col("label_binary").isNotNull()).alias("binary_rows"),
    ).withColumn("consistent", (F.col("benign_rows") == F.col("binary_zero"))
                 & (F.col("benign_rows") == F.col("multiclass_zero")) & (F.col("rows") == F.col("binary_rows")))


def label_mapping(spark: SparkSession, known: Vocabulary = PUBLISHED) -> DataFrame:
    """Label to ids and back."""
    return known.label_dim(spark)


def used_mapping(df: DataFrame, label: str = "label", known: Vocabulary = PUBLISHED) -> DataFrame:
    """The mapping with the number of rows that use each label, zero included."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("rows"))
    return label_mapping(df.sparkSession, known).join(counts, "label", "left").fillna(0, ["rows"])


def add_names(df: DataFrame, class_col: str, out: str, known: Vocabulary = PUBLISHED) -> DataFrame:
    """Name of a multiclass id; an unknown id becomes its text."""
    dim = known.label_dim(df.sparkSession).select(
        F.col("label_multiclass").cast("bigint").alias("_id"), F.col("label").alias("_name"))
    joined = df.join(F.broadcast(dim), F.col(class_col).cast("bigint") == F.col("_id"), "left")
    return joined.select(*df.columns, F.coalesce("_name", F.col(class_col).cast("string")).alias(out))


def binary_name(class_col: str):
    return F.when(F.col(class_col) == 1, "ATTACK").otherwise("BENIGN")
