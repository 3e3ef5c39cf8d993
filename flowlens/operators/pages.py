"""A scored table laid out for paging: rows in stream order, and a table of counts per block, level and class that tells which files a page
needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.operators.views import MAX_PAGE, page

BLOCK_ROWS = 8192  # of the order column
BLOCKS_AT_ONCE = 64
CLASS = "predicted_multiclass_label_name"


class PageStore:
    """`rows` are range-partitioned and sorted by the order column, so a range of it is a few row groups; `blocks` counts rows."""

    def __init__(self, spark: SparkSession, path: str, order_col: str = "stream_order"):
        self.spark, self.path, self.order_col = spark, path, order_col

    def write(self, scored: DataFrame) -> None:
        scored.repartitionByRange(self.order_col).sortWithinPartitions(self.order_col).write.mode("overwrite").option(
            f"parquet.bloom.filter.enabled#{CLASS}", "true").parquet(f"{self.path}/rows")
        at = F.col(self.order_col)
        counted = self.rows().groupBy(F.expr(f"`{self.order_col}` div {BLOCK_ROWS}").alias("block"), "alert_level", CLASS).agg(
            F.count("*").alias("n"), F.min(at).alias("low"), F.max(at).alias("high"),
            F.max(F.col("risk_score").try_cast("double")).alias("top"))
        counted.repartitionByRange("block").sortWithinPartitions("block").write.mode("overwrite").parquet(f"{self.path}/blocks")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def page(self, limit: int, offset: int = 0, alert_level: str | None = None, attack_type: str | None = None,
             min_risk: float | None = None, after: int | None = None) -> DataFrame:
        """The page of `views.page`, from the rows between the first and the last block that can hold it.

        Blocks are looked up some at a time. Without a risk or a start the counts are exact, so blocks that the offset passes are not
        read; else rows are counted until there are enough.
        """
        limit = min(max(limit, 1), MAX_PAGE)
        need, counts_tell = offset + limit + 1, min_risk is None and after is None
        blocks = self.spark.read.parquet(f"{self.path}/blocks")
        for name, value in (("alert_level", alert_level), (CLASS, attack_type)):
            if value is not None:
                blocks = blocks.where(F.col(name) == value)
        if min_risk is not None:
            blocks = blocks.where(F.col("top") >= min_risk)
        if after is not None:
            blocks = blocks.where(F.col("high") > after)
        kept: dict[int, list[int]] = {}  # block -> rows, first, last
        passed, last, enough = 0, -1 << 62, False
        while not enough:
            found = blocks.where(F.col("block") > last).select("block", "n", "low", "high").orderBy("block").limit(BLOCKS_AT_ONCE + 1).collect()
            more = len(found) > BLOCKS_AT_ONCE
            if more:  # the last block may not be whole
                whole = [r for r in found if r["block"] != found[-1]["block"]]
                found = whole or blocks.where(F.col("block") == found[-1]["block"]).select("block", "n", "low", "high").collect()
            for r in found:
                n, low, high = kept.get(r["block"], (0, r["low"], r["high"]))
                kept[r["block"]] = [n + r["n"], min(low, r["low"]), max(high, r["high"])]
            if found:
                last = found[-1]["block"]
            if counts_tell:
                while kept and passed + kept[min(kept)][0] <= offset:
                    passed += kept.pop(min(kept))[0]
                enough = passed + sum(n for n, _, _ in kept.values()) >= need
            elif more:
                enough = self._matching(kept, alert_level, attack_type, min_risk, after).limit(need).count() >= need
            enough = enough or not more
        return page(self._between(kept), limit, offset - passed, alert_level, attack_type, min_risk, after, self.order_col)

    def _between(self, kept: dict[int, list[int]]) -> DataFrame:
        at = F.col(self.order_col)
        if not kept:
            return self.rows().where(F.lit(False))
        return self.rows().where((at >= min(low for _, low, _ in kept.values())) & (at <= max(high for _, _, high in kept.values())))

    def _matching(self, kept, alert_level, attack_type, min_risk, after) -> DataFrame:
        rows = self._between(kept)
        for name, value in (("alert_level", alert_level), (CLASS, attack_type)):
            if value is not None:
                rows = rows.where(F.col(name) == value)
        if min_risk is not None:
            rows = rows.where(F.col("risk_score").try_cast("double") >= min_risk)
        return rows if after is None else rows.where(F.col(self.order_col) > after)
