"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

# The JVM compiles no method beyond 8000 bytes of bytecode. A wide projection fused into one larger method
# runs interpreted; below the limit Spark splits it instead.
JIT_LIMIT = "8000"


def build_session(master: str | None = None, app_name: str = "flowlens", **conf: str) -> SparkSession:
    """A session with the settings the operators expect; cluster settings win where given."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.codegen.hugeMethodLimit", JIT_LIMIT)
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application: they need not start where it is installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "flowlens.zip")  # the driver serves it from here
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    out.write(file, os.path.relpath(file, os.path.dirname(root)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def prepare(spark: SparkSession) -> None:
    """Runtime settings the operators rely on, also in a session made elsewhere."""
    ship_package(spark)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") != JIT_LIMIT:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", JIT_LIMIT)


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and staged tables, as named by the cluster.

    A local folder is made up only for a local master, as in tests.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that every executor can reach")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def remove_staged(spark: SparkSession, path: str) -> None:
    """Deletes a table made under `staging_path`, once nothing reads it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut_lineage(df):
    """Reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


AT_ONCE = 6


def at_once(spark: SparkSession, calls: Sequence[Callable], most: int = AT_ONCE) -> list:
    """The results of independent calls, `most` of them under way at a time: the small jobs of one run while another one plans."""
    if not calls:
        return []
    with ThreadPoolExecutor(min(most, len(calls))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(call)) for call in calls]]
