"""From separate feeds to one timeline: union, fingerprint, re-sends, latest state per feed and day."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.config import EntitySpec
from tidelog.functions.fingerprint import content_hash, total_order


def union_sources(feeds: dict[str, DataFrame], spec: EntitySpec) -> DataFrame:
    """Stack the feeds by column name; columns a feed does not own are NULL.

    A union, not a join: no feed has to be there first, and when each fact arrived is kept.
    """
    tagged = [
        feeds[source.name].select(
            spec.event_time,
            spec.event_day,
            spec.key,
            F.lit(source.name).alias(spec.source_tag),
            *source.owned,
        )
        for source in spec.sources
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return stacked.select(*spec.columns)


def with_fingerprint(events: DataFrame, spec: EntitySpec) -> DataFrame:
    return events.withColumn(spec.fingerprint, content_hash(spec.columns))


def drop_resent(events: DataFrame) -> DataFrame:
    """One row per content. All columns are keys, so Spark hashes instead of sorting, and copies
    collapse before the shuffle however many there are of one event."""
    return events.distinct()


def latest_per_source_day(events: DataFrame, spec: EntitySpec) -> DataFrame:
    """The last state each feed gave for a key on a day.

    Spark keeps one row per group within each input partition before shuffling, so a huge group
    sends at most one row per task. Identical events tie on everything and one of them remains:
    re-sends need no pass of their own.
    """
    group = Window.partitionBy(spec.key, spec.source_tag, spec.event_day)
    newest = group.orderBy(*total_order(spec, newest_first=True))
    return events.withColumn("_nth", F.row_number().over(newest)).filter("_nth = 1").drop("_nth")


#: Events a timeline row stands for: all of them, and those that differ.
STACKED, DEDUPLICATED = "_stacked", "_deduplicated"


def counted_timeline(events: DataFrame, spec: EntitySpec) -> DataFrame:
    """:func:`latest_per_source_day` of stacked events without fingerprint, with two more columns: how many events each
    row stands for, and how many different ones.

    The counts travel with the rows and can be summed where these are written, in the last stage. Counting
    on the way, before a shuffle, would count the tasks again that a lost executor makes Spark repeat. Contents are
    grouped first, spread over all tasks whatever their key, so hashes are made once for each content. Both groupings
    are combined before their shuffle.
    """
    contents = events.groupBy(*spec.columns).agg(F.count(F.lit(1)).alias(STACKED))
    order = [spec.event_time, spec.fingerprint, *spec.text_columns]
    rest = [column for column in spec.owned_columns if column not in order]
    group = [spec.key, spec.source_tag, spec.event_day]
    newest = (
        with_fingerprint(contents, spec)
        .groupBy(*group)
        .agg(
            F.max(F.struct(*order, *rest)).alias("_newest"),
            F.sum(STACKED).alias(STACKED),
            F.count(F.lit(1)).alias(DEDUPLICATED),
        )
    )
    columns = [F.col(c) if c in group else F.col(f"_newest.{c}").alias(c) for c in (*spec.columns, spec.fingerprint)]
    return newest.select(*columns, STACKED, DEDUPLICATED)


def unify(feeds: dict[str, DataFrame], spec: EntitySpec) -> DataFrame:
    """Timeline with one row per key, feed and day, without re-sends.

    A key has at most (feeds x calendar days) rows here, however often it occurs in the feeds. That
    bound is what the per-key windows further on rest on.
    """
    return latest_per_source_day(with_fingerprint(union_sources(feeds, spec), spec), spec)
