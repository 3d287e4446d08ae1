"""Invariants of a history, each as a job that counts violations: one row, 0 when all is well."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.config import EntitySpec

VIOLATIONS = "violations"


def check_one_current(history: DataFrame, spec: EntitySpec) -> DataFrame:
    """Keys whose number of current versions is not one."""
    per_key = history.groupBy(spec.key).agg(F.count_if(F.col(spec.is_current)).alias("current"))
    return per_key.agg(F.count_if(F.col("current") != 1).alias(VIOLATIONS))


def check_intervals(history: DataFrame, spec: EntitySpec) -> DataFrame:
    """Versions followed by one that does not start on the next day: a gap or an overlap."""
    versions = Window.partitionBy(spec.key).orderBy(spec.valid_from)
    starts = history.select(
        spec.key,
        F.date_add(spec.valid_to, 1).alias("expected"),
        F.lead(spec.valid_from).over(versions).alias("next"),
    )
    broken = F.col("next").isNotNull() & ~F.col("next").eqNullSafe(F.col("expected"))
    return starts.agg(F.count_if(broken).alias(VIOLATIONS))


def business_columns(spec: EntitySpec) -> list[str]:
    """What a version says about its entity; the end of its interval is not part of it."""
    return [
        spec.key,
        spec.event_time,
        spec.event_day,
        *spec.owned_columns,
        spec.day_sources,
        spec.valid_from,
    ]


def check_same_versions(left: DataFrame, right: DataFrame, spec: EntitySpec) -> DataFrame:
    """Versions in one history but not the other, duplicates included.

    Both sides are added up with opposite signs per distinct version, which is one shuffle of
    pre-summed rows instead of the two of a difference each way.
    """
    columns = business_columns(spec)
    signed = left.select(*columns, F.lit(1).alias("_sign")).unionByName(
        right.select(*columns, F.lit(-1).alias("_sign"))
    )
    net = signed.groupBy(*columns).agg(F.sum("_sign").alias("_net"))
    return net.agg(F.coalesce(F.sum(F.abs("_net")), F.lit(0)).alias(VIOLATIONS))
