"""Parquet tables by day whose days are cut into buckets of a key, so that work by key reads them without a shuffle.

Spark knows the buckets of tables in its catalog only. A table here is still a folder that any session can open: it is entered
in the session's catalog under a name made of its path when it is read. A rewrite goes to a folder of its own, and a pointer file
is switched when it is complete, so a write that fails leaves the old table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidelog.functions.days import day_set, days_of
from tidelog.sources.pointers import current_folder, fresh_folder, point_to, remove_but
from tidelog.sources.tables import DAYS, ROWS


def _name(folder: str) -> str:
    return f"tidelog_{hashlib.sha256(folder.encode()).hexdigest()[:24]}"


def write_buckets(
    rows: DataFrame, path: str, day: str, key: str, buckets: int, counts: dict[str, Column] | None = None, drop: tuple[str, ...] = ()
) -> dict[str, int]:
    """Write ``rows`` in place of the table at ``path``; returns the count of rows, that of days and any further ``counts``.

    Rows that are dealt by key to ``buckets`` tasks already are written where they are, a file for each day and
    bucket. Of other rows every task writes a file for each day and bucket it has rows of. Days, and days of a key,
    spread over the buckets by key, so no day is too large for a task.
    """
    spark = rows.sparkSession
    measured = Observation()
    metrics = {ROWS: F.count(F.lit(1)), **(counts or {}), **day_set(day)}
    before, folder = current_folder(spark, path), fresh_folder(path)
    (
        rows.observe(measured, *[metric.alias(name) for name, metric in metrics.items()])
        .drop(*drop)
        .write.format("parquet")
        .option("path", folder)
        .partitionBy(day)
        .bucketBy(buckets, key)
        .sortBy(key)
        .saveAsTable(_name(folder))
    )
    point_to(spark, folder)
    remove_but(spark, path, [before, folder])
    got = measured.get
    return {ROWS: got[ROWS], DAYS: len(days_of(got) - {None}), **{name: got[name] for name in counts or {}}}


def read_buckets(spark: SparkSession, path: str, schema: StructType, day: str, key: str, buckets: int) -> DataFrame:
    """The table at ``path``; ``schema`` is that of its rows, of which ``day`` comes last."""
    folder = current_folder(spark, path)
    if folder is None:
        raise FileNotFoundError(f"no table at {path}")
    name = _name(folder)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*[f for f in schema if f.name != day], schema[day]])
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (`{day}`) "
            f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{folder}'"
        )
        spark.catalog.recoverPartitions(name)
    return spark.table(name)
