"""Splits and samples. Order is by hash of the row id, so no choice depends on partitioning."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from flowlens.functions.columns import hash_key
from flowlens.operators.ordering import class_sizes, hash_cut

SEED = 42
TEST_SIZE = 0.2


def half_up(x: float) -> int:
    return math.floor(x + 0.5)


def train_test_split(
    df: DataFrame, class_col: str, row_id: str, test_size: float = TEST_SIZE, seed: int = SEED, flag: str = "is_test"
) -> DataFrame:
    """Marks the test rows: the same share of every class, at least two rows per class needed."""
    sizes = class_sizes(df, class_col)
    small = [c for c, n in sizes.items() if n < 2]
    if small:
        raise ValueError(f"classes with fewer than two rows cannot be split: {small}")
    quotas = {c: half_up(test_size * n) for c, n in sizes.items()}
    return hash_cut(df, class_col, row_id, quotas, seed, flag)


def allocate(sizes: Mapping, total: int) -> dict:
    """Rows per class for a proportional sample: whole parts first, then the largest fractions."""
    everything = sum(sizes.values())
    if everything <= total:
        return dict(sizes)
    shares = {c: total * (n / everything) for c, n in sizes.items()}
    take = {c: min(sizes[c], max(1, math.floor(s))) for c, s in shares.items()}
    by_fraction = sorted(sizes, key=lambda c: (shares[c] - math.floor(shares[c]), c))
    while sum(take.values()) > total:
        shrinkable = [c for c in by_fraction if take[c] > 1]
        if not shrinkable:
            break
        for c in shrinkable[: sum(take.values()) - total]:
            take[c] -= 1
    while sum(take.values()) < total:
        growable = [c for c in reversed(by_fraction) if take[c] < sizes[c]]
        for c in growable[: total - sum(take.values())]:
            take[c] += 1
    return take


def stratified_sample(df: DataFrame, class_col: str, row_id: str, size: int, seed: int = SEED) -> DataFrame:
    """Proportional sample of `size` rows with every column kept."""
    sizes = class_sizes(df, class_col)
    if sum(sizes.values()) <= size:
        return df
    return hash_cut(df, class_col, row_id, allocate(sizes, size), seed)


def cap_classes(df: DataFrame, class_col: str, row_id: str, caps: Mapping, seed: int = SEED) -> DataFrame:
    """At most `caps[class]` rows of each class; classes without a cap stay whole."""
    sizes = class_sizes(df, class_col)
    over = {c: cap for c, cap in caps.items() if sizes.get(c, 0) > cap}
    if not over:
        return df
    return hash_cut(df, class_col, row_id, {c: over.get(c, n) for c, n in sizes.items()}, seed)


def rows_by_id(df: DataFrame, ids: DataFrame, row_id: str) -> DataFrame:
    """Rows whose id is listed."""
    return df.join(ids.select(row_id), row_id, "left_semi")


def benign_split(
    df: DataFrame, row_id: str, target: str = "label_binary", validation: float = 0.1, seed: int = SEED
) -> DataFrame:
    """Benign rows only, with `is_validation`; the share is held between 5 and 40 per cent."""
    share = min(max(validation, 0.05), 0.4)
    benign = df.where(F.col(target) == 0)
    return train_test_split(benign, target, row_id, share, seed, "is_validation")


def split_rows(
    df: DataFrame, split: str, row_id: str, max_rows: int | None = None, flag: str = "is_test"
) -> DataFrame:
    """Rows of 'train', 'test' or 'full', optionally only the first ones in row order."""
    if split not in ("train", "test", "full"):
        raise ValueError("split must be train, test or full")
    chosen = df if split == "full" else df.where(F.col(flag) if split == "test" else ~F.col(flag))
    return chosen if max_rows is None else chosen.orderBy(row_id).limit(max_rows)


def shuffled(df: DataFrame, row_id: str, seed: int = SEED) -> DataFrame:
    """Global random order: a range partitioned sort by hash."""
    return df.orderBy(hash_key(row_id, seed), row_id)


def class_distribution(df: DataFrame, class_cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*class_cols).agg(F.count("*").alias("count"))
