"""A folder of fitted pipelines: each is fitted once, saved with all that scoring needs, and used again while its settings hold."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

TRAINED, REUSED, UNAVAILABLE = "trained", "reused", "unavailable"


class Unavailable(Exception):
    """A component that cannot be fitted here: no rows for it, or no implementation."""


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at the path, in whatever store it names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


class Registry:
    """Pipelines under `path`/task/model. The last stage of each holds its settings as text."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.found: dict[tuple[str, str], str] = {}

    def _place(self, task: str, model: str) -> str:
        return f"{self.path}/{task}/{model}"

    def load(self, task: str, model: str) -> PipelineModel:
        return PipelineModel.load(self._place(task, model))

    def obtain(self, task: str, model: str, settings: dict, fit: Callable[[], PipelineModel]) -> PipelineModel | None:
        """The saved pipeline if its settings are these, else a new one; None if the component is unavailable."""
        place, wanted = self._place(task, model), json.dumps(settings, sort_keys=True)
        if exists(self.spark, f"{place}/metadata"):
            saved = PipelineModel.load(place)
            if saved.stages[-1].get("settings") == wanted:
                self.found[task, model] = REUSED
                return saved
        try:
            made = fit()
        except Unavailable:
            self.found[task, model] = UNAVAILABLE
            return None
        made.stages[-1]._set(settings=wanted)
        made.write().overwrite().save(place)
        self.found[task, model] = TRAINED
        return made

    def statuses(self) -> DataFrame:
        """task, model, status of every component asked for."""
        rows = [(task, model, status) for (task, model), status in sorted(self.found.items())]
        return self.spark.createDataFrame(rows, "task string, model string, status string")
