"""Publish a rebuilt history after its check: readers see the old one or the new one, never a mixture.

A rebuild goes to a folder of its own. Its invariants are counted while it is written; only if none is violated does a
small pointer file name the new folder, which is one atomic rename. A rebuild that fails, or that breaks an
invariant, leaves the published history as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidelog.config import EntitySpec
from tidelog.operators.digests import day_digests
from tidelog.sources.pointers import current_folder, fresh_folder, point_to, remove_but
from tidelog.sources.tables import read_table, write_days

BROKEN_INTERVALS, NOT_ONE_CURRENT = "broken_intervals", "not_one_current"
_FLAGS = {BROKEN_INTERVALS: "_broken", NOT_ONE_CURRENT: "_not_one"}


class InvariantViolated(RuntimeError):
    """A rebuilt history that was not published, and how often it breaks each invariant."""

    def __init__(self, violations: dict[str, int]) -> None:
        super().__init__(", ".join(f"{name}={number}" for name, number in violations.items()))
        self.violations = violations


def with_violations(history: DataFrame, spec: EntitySpec) -> DataFrame:
    """Flag versions that do not end on the eve of the next one, and the first version of each key that has not one current.

    Directly after ``scd2`` this takes no further shuffle: the windows are by the same key.
    """
    versions = Window.partitionBy(spec.key).orderBy(spec.valid_from)
    whole_key = Window.partitionBy(spec.key)
    following, place = F.lead(F.struct(spec.valid_from)).over(versions), F.row_number().over(versions)
    next_start = following[spec.valid_from]
    current = F.count_if(F.col(spec.is_current)).over(whole_key)
    return history.withColumns(
        {
            _FLAGS[BROKEN_INTERVALS]: following.isNotNull() & ~next_start.eqNullSafe(F.date_add(spec.valid_to, 1)),
            _FLAGS[NOT_ONE_CURRENT]: (place == 1) & (current != 1),
        }
    )


def _digests(folder: str) -> str:
    return f"{folder}.digests"


def publish(history: DataFrame, path: str, spec: EntitySpec) -> dict[str, int]:
    """Write ``history`` by day below ``path``, check it, and make it the published one; returns its counts.

    Raises :class:`InvariantViolated`, with the old history still in place, if a version does not end on the eve of the next
    or a key has not exactly one current version. Digests of its days are stored beside it, a row for each. The history published before is kept for those still reading it; older ones are
    removed. One publisher at a time; readers need no care.
    """
    spark = history.sparkSession
    before, folder = current_folder(spark, path), fresh_folder(path)
    counts = {what: F.count_if(F.col(flag)) for what, flag in _FLAGS.items()}
    found = write_days(
        with_violations(history, spec), folder, spec.event_day, counts=counts, drop=list(_FLAGS.values()), key=spec.key
    )
    violations = {what: found[what] for what in _FLAGS}
    if any(violations.values()):
        remove_but(spark, path, [before, _digests(before)] if before else [])
        raise InvariantViolated(violations)
    day_digests(read_table(spark, folder, history.schema, spec.event_day), spec).write.parquet(_digests(folder))
    point_to(spark, folder)
    remove_but(spark, path, [f for kept in (before, folder) if kept for f in (kept, _digests(kept))])
    return found


def read_published(spark: SparkSession, path: str, schema: StructType, spec: EntitySpec) -> DataFrame:
    """The history published last. The frame stays on it while others are published, up to the next but one."""
    folder = current_folder(spark, path)
    if folder is None:
        raise FileNotFoundError(f"nothing has been published at {path}")
    return read_table(spark, folder, schema, spec.event_day)


def published_digests(spark: SparkSession, path: str) -> DataFrame:
    """Digests of the days of the history published last, for ``check_past_frozen``."""
    folder = current_folder(spark, path)
    if folder is None:
        raise FileNotFoundError(f"nothing has been published at {path}")
    return spark.read.parquet(_digests(folder))
