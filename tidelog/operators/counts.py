"""Row counts along the way from raw events to versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.config import EntitySpec


def source_day_counts(events: DataFrame, spec: EntitySpec) -> DataFrame:
    """Events and distinct days per feed. Spark first reduces to feed and day, then counts."""
    return events.groupBy(spec.source_tag).agg(
        F.count(F.lit(1)).alias("events"),
        F.countDistinct(spec.event_day).alias("days"),
    )


def stage_counts(events: DataFrame, spec: EntitySpec) -> DataFrame:
    """Rows after each stage, in one pass. Re-sends are events alike in all columns, as in ``drop_resent``.

    Every stage is a coarser grouping of the one before, so each level counts the groups below it
    and nothing is computed twice. Once events are down to key, feed and day, one shuffle by key
    serves the rest.
    """
    day = [spec.key, spec.event_day]
    contents = events.groupBy(*spec.columns).agg(F.count(F.lit(1)).alias("stacked"))
    feed_days = contents.groupBy(*day, spec.source_tag).agg(
        F.sum("stacked").alias("stacked"), F.count(F.lit(1)).alias("deduplicated")
    )
    days = (
        feed_days.repartition(F.col(spec.key))
        .groupBy(*day)
        .agg(
            F.sum("stacked").alias("stacked"),
            F.sum("deduplicated").alias("deduplicated"),
            F.count(F.lit(1)).alias("latest"),
        )
    )
    keys = days.groupBy(spec.key).agg(
        F.sum("stacked").alias("stacked"),
        F.sum("deduplicated").alias("deduplicated"),
        F.sum("latest").alias("latest"),
        F.count(F.lit(1)).alias("daily"),
    )
    # A day is a version, and the last version of each key is the current one.
    return keys.agg(
        *[
            F.coalesce(F.sum(stage), F.lit(0)).alias(stage)
            for stage in ("stacked", "deduplicated", "latest", "daily")
        ],
        F.coalesce(F.sum("daily"), F.lit(0)).alias("versions"),
        F.count(F.lit(1)).alias("current"),
    )
