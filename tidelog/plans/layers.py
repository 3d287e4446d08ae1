"""The layer chain: raw, typed events, timeline, daily state, history.

Each layer is a written table. That is where lineage ends: a lost executor costs the tasks of one
step, never a recomputation from raw.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidelog.config import EntitySpec
from tidelog.operators.history import scd2
from tidelog.operators.state import daily_state, fill_days, fold_days
from tidelog.operators.timeline import DEDUPLICATED, STACKED, counted_timeline, unify, union_sources
from tidelog.sources.buckets import read_buckets, write_buckets
from tidelog.sources.events import MALFORMED, REASON, typed_events, with_event_day
from tidelog.sources.tables import ROWS, read_table, start_together, write_days


@dataclass(frozen=True)
class Layers:
    """Where each table lives below a base path, which may be any Hadoop file system URI.

    With ``buckets`` timeline, daily states and history are cut into that many buckets by key within their days. The key is
    shuffled once, for the timeline; the steps after it read and write bucket by bucket. That takes a file for each
    day and bucket, so it is for tables whose days are many times as large as a file should be.
    """

    base: str
    spec: EntitySpec
    buckets: int | None = None

    @property
    def raw(self) -> str:
        return f"{self.base}/raw"

    def bronze(self, source: str) -> str:
        return f"{self.base}/bronze/{source}"

    @property
    def timeline(self) -> str:
        return f"{self.base}/silver/{self.spec.timeline_table}"

    @property
    def daily(self) -> str:
        return f"{self.base}/silver/{self.spec.daily_table}"

    @property
    def history(self) -> str:
        return f"{self.base}/gold/{self.spec.history_table}"


@dataclass(frozen=True)
class LayerRun:
    history: DataFrame
    counts: dict[str, dict[str, int]]

    def stage_counts(self, spec: EntitySpec) -> dict[str, int]:
        """Rows after each stage, from what the steps observed while they wrote."""
        timeline, history = self.counts[spec.timeline_table], self.counts[spec.history_table]
        return {
            "stacked": timeline["stacked"],
            "deduplicated": timeline["deduplicated"],
            "latest": timeline[ROWS],
            "daily": self.counts[spec.daily_table][ROWS],
            "versions": history[ROWS],
            "current": history["current"],
        }


def ingest(spark: SparkSession, layers: Layers) -> dict[str, dict[str, int]]:
    """Type every raw feed and store it by day; returns counts per table, like every step here.

    Rows without an event time are stored too, under the NULL day, and counted as ``undated``. Where a cell did not parse, the
    line as delivered and the reason are stored beside the typed row; :func:`malformed_lines` reads them.
    """
    spec = layers.spec
    counts = {
        "malformed": F.count_if(F.col(MALFORMED).isNotNull()),
        "undated": F.count_if(F.col(spec.event_day).isNull()),
    }

    def store(name: str, feed: DataFrame) -> dict[str, int]:
        return write_days(feed, layers.bronze(name), spec.event_day, counts=counts)

    stored = start_together(store, typed_events(spark, layers.raw, spec))
    return {f"bronze/{name}": got for name, got in stored.items()}


def malformed_lines(spark: SparkSession, layers: Layers) -> DataFrame:
    """``(feed, day, line, reason)`` of every line with a malformed cell. Row groups without one are skipped: all their
    lines are NULL."""
    found = [
        stored_layer(spark, layers, source.name, layers.bronze(source.name))
        .where(F.col(MALFORMED).isNotNull())
        .select(F.lit(source.name).alias("feed"), F.col(layers.spec.event_day).alias("day"), F.col(MALFORMED).alias("line"), F.col(REASON).alias("reason"))
        for source in layers.spec.sources
    ]
    return reduce(DataFrame.unionByName, found)


_SCHEMAS: dict[str, dict[str, StructType]] = {}


def _schemas(spark: SparkSession, spec: EntitySpec) -> dict[str, StructType]:
    """Schema of every stored table, found once for each spec by planning the chain over feeds without rows."""
    if (known := _SCHEMAS.get(repr(spec))) is None:
        known = _SCHEMAS[repr(spec)] = _planned_schemas(spark, spec)
    return known


def _planned_schemas(spark: SparkSession, spec: EntitySpec) -> dict[str, StructType]:
    feeds = {
        source.name: spark.createDataFrame([], ", ".join(f"`{c}` {kind}" for c, kind in source.schema.items()))
        for source in spec.sources
    }
    lost = {name: F.lit(None).cast("string") for name in (MALFORMED, REASON)}
    feeds = {name: with_event_day(feed.withColumns(lost), spec) for name, feed in feeds.items()}
    timeline = unify(feeds, spec)
    daily = daily_state(timeline, spec)
    frames = {**feeds, spec.timeline_table: timeline, spec.daily_table: daily}
    return {name: frame.schema for name, frame in frames.items()} | {spec.history_table: scd2(daily, spec).schema}


def stored_layer(spark: SparkSession, layers: Layers, name: str, path: str) -> DataFrame:
    """A stored table of the chain by its name: a feed, or one of the tables the spec names."""
    spec = layers.spec
    schema = _schemas(spark, spec)[name]
    if layers.buckets and name in (spec.timeline_table, spec.daily_table, spec.history_table):
        return read_buckets(spark, path, schema, spec.event_day, spec.key, layers.buckets)
    return read_table(spark, path, schema, spec.event_day)


def _store(
    rows: DataFrame, layers: Layers, path: str, counts: dict[str, Column] | None = None, drop: tuple[str, ...] = (), key: str | None = None
) -> dict[str, int]:
    day = layers.spec.event_day
    if layers.buckets:
        return write_buckets(rows, path, day, layers.spec.key, layers.buckets, counts, drop)
    return write_days(rows, path, day, counts=counts, drop=drop, key=key)


def build_timeline(spark: SparkSession, layers: Layers) -> dict[str, dict[str, int]]:
    """Undated events go through like all others; they sort before everything else of their key. Beside its rows the step
    counts the events ``stacked`` and those left of them without re-sends, ``deduplicated``."""
    spec = layers.spec
    feeds = {s.name: stored_layer(spark, layers, s.name, layers.bronze(s.name)) for s in spec.sources}
    timeline = counted_timeline(union_sources(feeds, spec), spec)
    if layers.buckets:
        # A key has at most a row for each feed and calendar day here.
        timeline = timeline.repartition(layers.buckets, spec.key)
    counts = {name: F.coalesce(F.sum(column), F.lit(0)) for name, column in (("stacked", STACKED), ("deduplicated", DEDUPLICATED))}
    return {spec.timeline_table: _store(timeline, layers, layers.timeline, counts, (STACKED, DEDUPLICATED))}


def build_daily(spark: SparkSession, layers: Layers) -> dict[str, dict[str, int]]:
    spec = layers.spec
    timeline = stored_layer(spark, layers, spec.timeline_table, layers.timeline)
    # A stored timeline in buckets is dealt by key as it is read.
    daily = fill_days(fold_days(timeline, spec), spec) if layers.buckets else daily_state(timeline, spec)
    return {spec.daily_table: _store(daily, layers, layers.daily)}


def build_history(spark: SparkSession, layers: Layers) -> dict[str, dict[str, int]]:
    spec = layers.spec
    current = {"current": F.count_if(F.col(spec.is_current))}
    versions = scd2(stored_layer(spark, layers, spec.daily_table, layers.daily), spec)
    return {spec.history_table: _store(versions, layers, layers.history, current, key=spec.key)}


def run_layers(spark: SparkSession, base_path: str, spec: EntitySpec, buckets: int | None = None) -> LayerRun:
    """Rebuild every layer from raw, one after the other; an error stops the chain.

    Always a full rebuild: replacing only the days present would leave behind the old day of an
    event that has moved.
    """
    layers = Layers(base_path.rstrip("/"), spec, buckets)
    counts = ingest(spark, layers)
    counts |= build_timeline(spark, layers)
    counts |= build_daily(spark, layers)
    counts |= build_history(spark, layers)
    return LayerRun(stored_layer(spark, layers, spec.history_table, layers.history), counts)
