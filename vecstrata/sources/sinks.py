"""What the recall harness writes: a table on screen, CSV rows, cached ground truth."""

from __future__ import annotations

import hashlib
import json
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.recall import ROW_SCHEMA


def format_table(rows: list[tuple], ks: list[int]) -> str:
    """An aligned table: a line per configuration, with pools and recalls for each k."""
    names = [c.split()[0] for c in ROW_SCHEMA.split(", ")]
    by: dict[str, list[dict]] = {}
    for r in rows:
        d = dict(zip(names, r, strict=True))
        by.setdefault(d["config"], []).append(d)
    width = max([6, *map(len, by)])
    lines = ["config".ljust(width) + "".join(f"  {f'R@{k}':>6}" for k in ks) + "".join(f"  {f'recall@{k}':>11}" for k in ks) + f"  {'us/q':>8}"]
    for label, found in by.items():
        at = {d["k"]: d for d in found}
        lines.append(label.ljust(width) + "".join(f"  {at[k]['r'] or '-':>6}" for k in ks) + "".join(f"  {at[k]['recall']:>11.4f}" for k in ks) + f"  {found[0]['us_per_query']:>8.0f}")
    return "\n".join(lines)


def append_csv(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    """Adds the rows to a folder of CSV files with headers."""
    df = spark.createDataFrame(rows, ROW_SCHEMA)
    df = df.withColumns({"recall": F.round("recall", 6), "us_per_query": F.round("us_per_query", 1)})
    df.coalesce(1).write.mode("append").option("header", True).csv(path)


def fingerprint(df: DataFrame) -> str:
    """A digest of a table's rows in any order."""
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return f"{r['n']}-{r['h']}"


def truth_path(base: str, s: float) -> str:
    """One cache per selectivity."""
    return f"{base}.s{s:.4f}"


def load_or_compute_truth(spark: SparkSession, path: str | None, params: dict, compute: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """Ground truth, and whether it came from the cache at path.

    The cache counts only if it was made for the same params, which should name the
    contents of both sides, and if all its rows can be read and add up to the digest
    kept beside them; any damage makes it a miss. A cache that can't be written is a warning.
    """
    if path is None:
        return compute(), False
    at = f"{path}/{hashlib.sha256(json.dumps(params, sort_keys=True).encode()).hexdigest()}"
    try:
        rows = spark.read.parquet(f"{at}/rows")
        if spark.read.text(f"{at}/digest").first()["value"] == fingerprint(rows):
            return rows, True
    except Exception as e:  # a cache is never an error
        warnings.warn(f"no ground truth is read from {at}: {type(e).__name__}", stacklevel=2)
    truth = compute()
    try:
        truth.write.mode("overwrite").parquet(f"{at}/rows")
        rows = spark.read.parquet(f"{at}/rows")
        spark.createDataFrame([(fingerprint(rows),)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/digest")
    except Exception as e:
        warnings.warn(f"ground truth isn't kept in {at}: {type(e).__name__}", stacklevel=2)
        return truth, False
    return rows, False
