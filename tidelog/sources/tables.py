"""Parquet tables partitioned by day, on any Hadoop file system."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidelog.functions.days import day_set, days_of

ROWS, DAYS = "rows", "days"
_MOST_TOGETHER = 8
_NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"
T = TypeVar("T")


def start_together(
    write: Callable[[str, DataFrame], T], frames: dict[str, DataFrame]
) -> dict[str, T]:
    """Run one write per frame at the same time. They are independent jobs, and the long tail of one
    should leave no executor idle. They belong to the caller's job group and scheduler pool. The first error
    is raised once all have ended."""
    if not frames:
        return {}
    start = inheritable_thread_target(next(iter(frames.values())).sparkSession)(write)
    with ThreadPoolExecutor(min(_MOST_TOGETHER, len(frames))) as pool:
        return dict(zip(frames, pool.map(start, frames.keys(), frames.values()), strict=True))


def read_table(spark: SparkSession, path: str, schema: StructType, *by: str) -> DataFrame:
    """A stored table of known ``schema``; the columns ``by`` that it is partitioned by come last. Works for a table
    without rows."""
    columns = [field for field in schema if field.name not in by]
    return spark.read.schema(StructType([*columns, *[schema[name] for name in by]])).parquet(path)


def folders(spark: SparkSession, path: str) -> set[str]:
    """Names of a table's folders, one for each value of its first partition column; one listing, no files."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.listStatus(root) if fs.exists(root) else ()
    return {f.getPath().getName() for f in found if f.isDirectory() and "=" in f.getPath().getName()}


def remove(spark: SparkSession, path: str, names: Iterable[str]) -> None:
    for name in names:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def day_folder(day: str, value: dt.date | None) -> str:
    return f"{day}={_NULL_FOLDER if value is None else value.isoformat()}"


def write_days(
    rows: DataFrame,
    path: str,
    day: str,
    only_days: Sequence[dt.date | None] | None = None,
    counts: dict[str, Column] | None = None,
    drop: Sequence[str] = (),
    key: str | None = None,
) -> dict[str, int]:
    """Write ``rows`` partitioned by ``day``; returns the count of rows, that of days and any further ``counts``.

    A full write replaces the table, so a day that is gone from the input is gone from the output.
    ``only_days`` replaces the named days and leaves the rest alone: a named day without rows is empty
    afterwards, a row of another day is an error. New days are put in place when all are written, and
    only then are the days removed that have no rows any more: a write that fails leaves the old table.
    Which days were written is observed by the write itself, so that no file is ever listed.

    Rebalancing puts a day's rows together, so a day is a few files rather than one per task; a day
    too big for one task, be it a third of the table, is split. With ``key`` the rows of a file are sorted by it
    and every row group has a Bloom filter on it, so that a reader of one key skips most of them. Counts are taken while
    writing, in the last stage, where a retried task is not counted twice. Columns named in ``drop``
    are there for the counts and not stored.
    """
    spark = rows.sparkSession
    measured = Observation()
    metrics = {ROWS: F.count(F.lit(1)), **(counts or {}), **day_set(day)}
    before = folders(spark, path)
    if only_days is not None:
        named = F.lit(False)
        for value in only_days:
            named = named | F.col(day).eqNullSafe(F.lit(value).cast("date"))
        stray = F.raise_error(F.concat(F.lit("row of a day that is not refreshed: "), F.coalesce(F.col(day).cast("string"), F.lit("NULL"))))
        rows = rows.withColumn(day, F.when(named, F.col(day)).otherwise(stray.cast("date")))
    placed = rows.hint("rebalance", F.col(day))
    if key is not None:
        placed = placed.sortWithinPartitions(day, key)
    writer = (
        placed.observe(measured, *[metric.alias(name) for name, metric in metrics.items()])
        .drop(*drop)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(day)
    )
    if key is not None:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.parquet(path)
    got = measured.get
    written = days_of(got)
    replaced = before if only_days is None else before & {day_folder(day, value) for value in only_days}
    remove(spark, path, replaced - {day_folder(day, value) for value in written})
    return {ROWS: got[ROWS], DAYS: len(written - {None}), **{name: got[name] for name in counts or {}}}
