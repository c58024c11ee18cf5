"""The folder that driver and executors share, and small helpers of the operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Only a local session (as in tests) may leave it unset; it then gets a
    temporary folder of its own, set as the checkpoint folder too.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="vecstrata-")
        sc.setCheckpointDir(_LOCAL[sc.applicationId])
    return _LOCAL[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(table: DataFrame) -> DataFrame:
    """A table just read, in as many partitions as there are cores at least: few or single-group files don't fill them."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, under fixed names: extra or clashing ones can't interfere."""
    return df.select(*[df[c].alias(name) for name, c in wanted.items()])


_KEPT: dict[str, Any] = {}


def worker_state(name: str, make: Callable[[], Any]) -> Any:
    """This worker's object of that name. A worker keeps one from task to task; another name takes its place.

    Workers outlive stages, so what one operator remembers must not stay beside what the next one needs.
    """
    if name not in _KEPT:
        _KEPT.clear()
        gc.collect()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)  # hands freed memory back
        except (OSError, AttributeError):
            pass  # another C library
        _KEPT[name] = make()
    return _KEPT[name]


def hot_join(left: DataFrame, right: DataFrame, key: str, rows: int, *, least_hot: int = 512, most_hot: int = 100_000) -> DataFrame:
    """left joined with right, which has one row per key and in `n` about how many rows of left have it.

    Keys with many of left's `rows` rows are split into parts of their own: the list
    of these keys is short, for each has at least one part in most_hot of all rows.
    """
    most = max(least_hot, -(-2 * rows // most_hot))
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / most)).cast("int")
    hot = right.where(F.col("n") > most).select(key, parts.alias("_parts"))
    others = [c for c in left.columns if c != key]
    left = left.join(F.broadcast(hot), key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*(others or [key])), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    right = right.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.join(right, [key, "_part"]).drop("_part")
