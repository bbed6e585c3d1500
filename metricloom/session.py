"""Session settings the operators rely on."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# AQE picks partition counts, join strategies and skew splits from runtime sizes; the
# shuffle count is only the upper bound it coalesces from.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings results depend on; cluster sizing is left alone."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", name: str = "metricloom", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; cores=* means every core."""
    width = "8" if cores == "*" else str(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", width)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**RUNTIME, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the cluster's own; only a local master may do with a temporary one."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if configured is None and context.getCheckpointDir() is None and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="metricloom-checkpoint-"))
    return configured or context.getCheckpointDir()


def settle(df: DataFrame, compression: str | None = "zstd") -> DataFrame:
    """Write a result that later steps read more than once, and read it back.

    It goes to the shared checkpoint folder as Parquet, so it outlives lost executors, is read
    by column and carries its size for join planning. It is removed when the session's file
    system closes.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(location)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """Bring a small result back once and give it out as a local table.

    For frames of a row per table, column, role, KPI or finding, however large the data: what
    reads them later neither computes them again nor opens files. Larger results are settled.
    """
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_lock = threading.Lock()
_unmeasured: dict[SparkSession, tuple[int, str | None]] = {}


@contextmanager
def by_rows(spark: SparkSession) -> Iterator[None]:
    """Jobs that give rows of a few numbers to Python: their batches end by number of rows alone.

    The limit in bytes is checked for every row by adding up all columns, which takes several times as long as the
    rows do. Rows of numbers need no such limit. Jobs side by side share the setting; the last one puts it back.
    """
    with _lock:
        n, before = _unmeasured.get(spark) or (0, spark.conf.get(_BATCH_BYTES, None))
        _unmeasured[spark] = n + 1, before
        spark.conf.set(_BATCH_BYTES, str(2**31 - 1))
    try:
        yield
    finally:
        with _lock:
            n, before = _unmeasured.pop(spark)
            if n > 1:
                _unmeasured[spark] = n - 1, before
            elif before is None:
                spark.conf.unset(_BATCH_BYTES)
            else:
                spark.conf.set(_BATCH_BYTES, before)


def together(*calls: Callable[[], Any]) -> list:
    """Run independent Spark jobs side by side, so that one's tail does not leave cores idle."""
    if len(calls) == 1:
        return [calls[0]()]
    inherit = inheritable_thread_target(SparkSession.active())  # job groups and other local settings
    with ThreadPoolExecutor(max_workers=min(4, len(calls))) as pool:
        return [f.result() for f in [pool.submit(inherit(c)) for c in calls]]
