"""State of an entity: carry each feed's last block forward, one row per day.

NULL has two meanings in an owned column: the feed said nothing (inherit) or the feed said "empty"
(do not inherit). Column-wise filling cannot tell them apart. A whole block is a struct that is
there whenever its feed spoke, even with every field empty, so the struct is what gets carried.

Where a function says timeline, it means the result of ``latest_per_source_day`` or ``unify``: at
most one row per key, feed and day.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidelog.config import EntitySpec, SourceSpec
from tidelog.functions.fingerprint import total_order


BLOCK, LAST = "_block_{}", "_last"


def _block(source: SourceSpec) -> str:
    return BLOCK.format(source.name)


def _spoke(spec: EntitySpec, source: SourceSpec) -> Column:
    return F.col(spec.source_tag) == source.name


def _up_to_here(spec: EntitySpec, *order: Column | str) -> WindowSpec:
    window = Window.partitionBy(spec.key).orderBy(*order)
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _text_first(source: SourceSpec) -> list[str]:
    """Owned columns in the order that settles equal hashes, as in ``total_order``."""
    return source.text_columns + [c for c in source.owned if c not in source.text_columns]


def _owned_from_blocks(spec: EntitySpec) -> list[Column]:
    return [
        F.col(f"{_block(source)}.{column}").alias(column)
        for source in spec.sources
        for column in source.owned
    ]


def block_forward_fill(timeline: DataFrame, spec: EntitySpec) -> DataFrame:
    """Each row with the latest block of every feed so far; it never looks ahead.

    All blocks share one window, hence one shuffle and one sort.
    """
    so_far = _up_to_here(spec, *total_order(spec))
    carried = timeline.select(
        *spec.key_columns,
        spec.fingerprint,
        *[
            F.last(F.when(_spoke(spec, source), F.struct(*source.owned)), ignorenulls=True)
            .over(so_far)
            .alias(_block(source))
            for source in spec.sources
        ],
    )
    return carried.select(*spec.key_columns, *_owned_from_blocks(spec), spec.fingerprint)


def with_day_sources(timeline: DataFrame, spec: EntitySpec) -> DataFrame:
    """Add which feeds spoke that day about that key, sorted."""
    day = Window.partitionBy(spec.key, spec.event_day)
    return timeline.withColumn(
        spec.day_sources, F.sort_array(F.collect_set(spec.source_tag).over(day))
    )


def collapse_days(filled: DataFrame, spec: EntitySpec) -> DataFrame:
    """Last row of each key's day; being cumulative, it holds everything known by then."""
    newest = Window.partitionBy(spec.key, spec.event_day).orderBy(
        *total_order(spec, newest_first=True)
    )
    return (
        with_day_sources(filled, spec)
        .withColumn("_nth", F.row_number().over(newest))
        .filter("_nth = 1")
        .drop("_nth", spec.source_tag)
    )


def _part_of_block(source: SourceSpec, fields: Iterable[str]) -> Column:
    """Some fields of a feed's block; NULL if the feed did not speak."""
    block = F.col(_block(source))
    return F.when(block.isNotNull(), F.struct(*[block[name].alias(name) for name in fields]))


def fold_days(events: DataFrame, spec: EntitySpec) -> DataFrame:
    """One row per key and day with the last block of each feed, NULL where it was silent.

    Takes the timeline as well as plain fingerprinted events: of several events of a feed on a day
    the newest is what a maximum keeps, and re-sends change no maximum. Input partitions are folded
    before the shuffle, so a key or day of any size sends at most one row per task.
    """
    order = [spec.event_time, spec.fingerprint]
    return events.groupBy(spec.key, spec.event_day).agg(
        *[
            F.max(F.when(_spoke(spec, source), F.struct(*order, *_text_first(source)))).alias(
                _block(source)
            )
            for source in spec.sources
        ],
    )


def said_on_days(days: DataFrame, spec: EntitySpec) -> DataFrame:
    """Folded days with the feeds that spoke, the moment of the last event, and the blocks without time and hash.

    Time and hash of each block have done their work by then: the latest of them is kept for the
    day, the rest is not shuffled again.
    """
    moments = [
        _part_of_block(source, [spec.event_time, spec.fingerprint]) for source in spec.sources
    ]
    spoke_today = [
        F.when(F.col(_block(source)).isNotNull(), F.lit(source.name))
        for source in sorted(spec.sources, key=lambda s: s.name)
    ]
    return days.select(
        spec.key,
        spec.event_day,
        (F.greatest(*moments) if len(moments) > 1 else moments[0]).alias(LAST),
        F.array_compact(F.array(*spoke_today)).alias(spec.day_sources),
        *[_part_of_block(source, source.owned).alias(_block(source)) for source in spec.sources],
    )


def carry_blocks(said: DataFrame, spec: EntitySpec) -> DataFrame:
    """Carry the blocks of what was said on days forward. A key has at most one row per calendar day here, so
    the window by key stays small whatever the key's share of the events."""
    so_far = _up_to_here(spec, spec.event_day)
    carried = said.select(
        spec.key,
        spec.event_day,
        LAST,
        spec.day_sources,
        *[
            F.last(_block(source), ignorenulls=True).over(so_far).alias(_block(source))
            for source in spec.sources
        ],
    )
    return carried.select(
        F.col(f"{LAST}.{spec.event_time}").alias(spec.event_time),
        spec.event_day,
        spec.key,
        *_owned_from_blocks(spec),
        F.col(f"{LAST}.{spec.fingerprint}").alias(spec.fingerprint),
        spec.day_sources,
    )


def fill_days(days: DataFrame, spec: EntitySpec) -> DataFrame:
    return carry_blocks(said_on_days(days, spec), spec)


def daily_state(timeline: DataFrame, spec: EntitySpec) -> DataFrame:
    """One row per key and day with all blocks filled, in one shuffle.

    Equal to ``collapse_days(block_forward_fill(timeline))`` but folds the day first, so the window
    runs over days instead of events. A timeline is bounded per key, so it can be hashed by key at
    once; fold and window both follow from that, and the fold leaves the order the window wants.
    """
    return fill_days(fold_days(timeline.repartition(F.col(spec.key)), spec), spec)


def daily_state_of_events(events: DataFrame, spec: EntitySpec) -> DataFrame:
    """Same result straight from fingerprinted events, where a key is not bounded: fold in place
    and shuffle folded days only."""
    return fill_days(fold_days(events, spec), spec)
