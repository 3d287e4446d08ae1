"""Put late events into stored layers: only what they change is computed, only the days it lies on are rewritten."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.config import EntitySpec
from tidelog.operators.history import scd2
from tidelog.operators.repair import (
    changed,
    first_touched,
    from_touched_on,
    in_force_before,
    renewed_states,
    renewed_timeline,
)
from tidelog.plans.layers import Layers, stored_layer
from tidelog.session import shared_folder
from tidelog.sources.tables import write_days

Days = list[dt.date | None]


def _days(rows: DataFrame, day: str) -> Days:
    """The days of some rows: no more than there are in a calendar."""
    return [r[0] for r in rows.select(day).distinct().collect()]


def _on(days: Days, day: str):
    dated = [d for d in days if d is not None]
    found = F.col(day).isin(dated) if dated else F.lit(False)
    return found | F.col(day).isNull() if None in days else found


def _replace(stored: DataFrame, rows: DataFrame, path: str, group: list[str], day: str, key: str | None = None) -> Days:
    """Rewrite the days of ``rows`` in the table ``stored`` at ``path``, where they replace those alike in ``group``."""
    days = _days(rows, day)
    if days:
        here = stored.where(_on(days, day)).alias("stored")
        new = rows.select(*group).alias("new")
        alike = reduce(lambda a, b: a & b, [F.col(f"stored.{c}").eqNullSafe(F.col(f"new.{c}")) for c in group])
        write_days(here.join(new, alike, "left_anti").unionByName(rows), path, day, only_days=days, key=key)
    return days


def refresh_layers(spark: SparkSession, layers: Layers, late: DataFrame) -> dict[str, Days]:
    """Bring timeline, daily states and history up to date with ``late``, stacked events with their day; returns the days
    rewritten in each. The tables are then those of a full rebuild with these events among the others.

    All changes are found and stored before the first table is touched, and finding them again changes nothing: a refresh that
    fails half way is repaired by running it again. Re-sends and events known already rewrite nothing. Events
    without a time count from the beginning. Storing ``late`` with the raw or typed events, for the next full rebuild, is up to
    the caller.
    """
    spec: EntitySpec = layers.spec
    if layers.buckets:
        raise ValueError("layers in buckets are rebuilt as a whole")
    day, kept = spec.event_day, shared_folder(spark, "refresh")

    def settled(name: str, rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{kept}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{kept}/{name}")

    late = settled("late", late.select(*spec.columns).distinct())
    touched = settled("touched", first_touched(late, spec))
    timeline, daily, history = (
        stored_layer(spark, layers, name, path)
        for name, path in (
            (spec.timeline_table, layers.timeline),
            (spec.daily_table, layers.daily),
            (spec.history_table, layers.history),
        )
    )
    new_timeline = settled("timeline", renewed_timeline(timeline, late, touched, spec))
    before = settled("before", in_force_before(history, touched, spec))
    states = renewed_states(new_timeline, before, spec)
    new_states = states.where(F.col(spec.fingerprint).isNotNull())
    known_versions = from_touched_on(history, touched, spec).unionByName(before)
    renewed = {
        spec.timeline_table: settled("changed_timeline", changed(new_timeline, from_touched_on(timeline, touched, spec))),
        spec.daily_table: settled("changed_daily", changed(new_states, from_touched_on(daily, touched, spec))),
        spec.history_table: settled("changed_history", changed(scd2(states, spec), known_versions)),
    }
    rewritten = {
        spec.timeline_table: _replace(timeline, renewed[spec.timeline_table], layers.timeline, [spec.key, spec.source_tag, day], day),
        spec.daily_table: _replace(daily, renewed[spec.daily_table], layers.daily, [spec.key, day], day),
        spec.history_table: _replace(history, renewed[spec.history_table], layers.history, [spec.key, day], day, spec.key),
    }
    folder = spark._jvm.org.apache.hadoop.fs.Path(kept)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return rewritten
