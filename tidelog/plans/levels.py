"""A history stored by the length and the start of its intervals, so that a day is found in a handful of folders.

Stored by the day a version starts, reading the state of day D has to open every day up to D: a version from long ago may
still hold. Here a version that holds for ``n`` days is stored at level ``floor(log2(n))``, in the cell of its start, and
the cells of level ``l`` are ``2**l`` days wide. Such a version holds for less than two cells, so on day D it
can only have started in the cell of D or in one of the two before. Three cells at each level, and the levels grow with
the log of the days. Versions that still hold have no length; they are one more level with a single cell, sorted by start:
those that started by D are all part of the answer, and row groups that start later are skipped.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidelog.config import EntitySpec
from tidelog.functions.validity import valid_on
from tidelog.sources.tables import read_table

LEVEL, CELL = "level", "cell"
OPEN = -1
_TOP = 22  # 2**22 days are more than a date can tell apart
_EPOCH = dt.date(1970, 1, 1)


def with_cells(history: DataFrame, spec: EntitySpec) -> DataFrame:
    """Add the level and the cell of each version. A version without a start is in force on no day, and has neither."""
    days = F.greatest(F.datediff(spec.valid_to, spec.valid_from) + 1, F.lit(1))
    level = F.when(F.col(spec.valid_to).isNull(), F.lit(OPEN)).otherwise(F.length(F.bin(days.cast("bigint"))) - 1)
    dated = F.col(spec.valid_from).isNotNull()
    return history.withColumn(LEVEL, F.when(dated, level)).withColumn(
        CELL, F.when(F.col(LEVEL) >= 0, F.expr(f"shiftright(unix_date(`{spec.valid_from}`), {LEVEL})")).when(F.col(LEVEL) == OPEN, 0)
    )


def cells_on(day: dt.date) -> Column:
    """Where the versions in force on ``day`` can be, over the partition columns alone."""
    number = (day - _EPOCH).days
    found = F.col(LEVEL) == OPEN
    for level in range(_TOP + 1):
        own = number >> level
        found = found | ((F.col(LEVEL) == level) & F.col(CELL).between(own - 2, own))
    return found


def write_levels(history: DataFrame, path: str, spec: EntitySpec) -> None:
    """Store a history by level and cell, in place of what is there. A large cell is split over tasks; files are sorted
    by start."""
    (
        with_cells(history, spec)
        .hint("rebalance", F.col(LEVEL), F.col(CELL))
        .sortWithinPartitions(LEVEL, CELL, spec.valid_from)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy(LEVEL, CELL)
        .parquet(path)
    )


def read_levels(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A history stored by :func:`write_levels`; ``schema`` is the history's own."""
    cells = [StructField(LEVEL, IntegerType()), StructField(CELL, IntegerType())]
    return read_table(spark, path, StructType([*schema, *cells]), LEVEL, CELL)


def as_of_levels(stored: DataFrame, spec: EntitySpec, day: dt.date) -> DataFrame:
    """The version of each key in force on ``day``, from a history stored by level: same rows as ``as_of``."""
    return stored.filter(cells_on(day) & valid_on(spec, day)).drop(LEVEL, CELL)
