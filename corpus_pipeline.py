"""The corpus pipeline: from raw documents to packed training sequences.

Stages, each applied to all rows that the one before it kept:

1. quality: documents that the repetition rules reject go;
2. near_copies: one document of each group of near copies stays, the one with the smallest doc_id;
3. repeats: long strings that an earlier document has are cut out of the texts;
4. mix: documents are taken as often as their source's target asks for;
5. pack: the texts are tokenised and packed into sequences.

Every result is written as Parquet to the shared folder and read again as the next stage's input. All stages take an empty table and
return an empty one, keep rows that repeat each other's doc_id as said below, and keep columns beside those of documents but in the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.llm import jaccard_join, mixing, packing, quality, suffix_dedup
from flowlens.llm.queries import tokenizer_file
from flowlens.session import staging_path
from flowlens.sources.bindings import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null or empty text has too few words and goes; rows are judged one by one, so repeated rows go or stay together."""
    return quality.score(docs).where("kept").select(docs.columns)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words are like nothing and stay, as do rows without a doc_id; rows that repeat the doc_id that stays stay too."""
    return jaccard_join.one_of_each(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text that is left; a text of which nothing is left stays as an empty one, a null text becomes empty. Rows
    without a doc_id, and rows with the same one, lose nothing to each other."""
    left = suffix_dedup.remove_repeats(docs)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row comes as often as the mix takes it; rows with the same doc_id in a source come together; rows without a source are one
    source; a source without words is not taken."""
    return mixing.mixed_rows(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document; a null or empty text is the id of its end alone; every row is packed, repeated ones too."""
    return packing.pack_documents(docs, tokenizer_file())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage), ("near_copies", near_copies_stage), ("repeats", repeats_stage), ("mix", mix_stage),
    ("pack", pack_stage),
]

# The tokenizer of the last stage has no SQL form; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = staging_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
