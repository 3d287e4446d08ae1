"""Feeds that arrive together: one log, split into a table per feed in one pass, and read again apart or at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidelog.config import EntitySpec, SourceSpec


def split_feeds(log: DataFrame, path: str, spec: EntitySpec) -> dict[str, int]:
    """Store the rows of a log below ``path`` by the feed their tag names; returns the rows of each feed.

    One job without a shuffle: every task writes a file for each feed it has rows of. A row of a feed that is not known,
    or of none, is an error. What was there is replaced.
    """
    tag = F.col(spec.source_tag)
    names = [source.name for source in spec.sources]
    unknown = F.raise_error(F.concat(F.lit("row of an unknown feed: "), F.coalesce(tag, F.lit("NULL"))))
    measured = Observation()
    (
        log.withColumn(spec.source_tag, F.when(tag.isin(names), tag).otherwise(unknown.cast("string")))
        .observe(measured, *[F.count_if(tag == name).alias(name) for name in names])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy(spec.source_tag)
        .parquet(path)
    )
    return measured.get


def _columns(spec: EntitySpec, sources: tuple[SourceSpec, ...]) -> str:
    """Types of what a split log holds: the day is derived, whatever type it was delivered in."""
    kinds = {spec.event_time: sources[0].schema[spec.event_time], spec.event_day: "DATE", spec.key: sources[0].schema[spec.key]}
    kinds |= {column: source.schema[column] for source in sources for column in source.owned}
    return ", ".join(f"`{column}` {kind}" for column, kind in kinds.items())


def one_feed(spark: SparkSession, path: str, spec: EntitySpec, source: SourceSpec) -> DataFrame:
    """The rows of one feed, with the columns it delivers. Only its own folder is read; a feed without rows has none."""
    stored = spark.read.schema(f"{_columns(spec, (source,))}, `{spec.source_tag}` STRING").parquet(path)
    return stored.where(F.col(spec.source_tag) == source.name).drop(spec.source_tag)


def all_feeds(spark: SparkSession, path: str, spec: EntitySpec) -> DataFrame:
    """All feeds stacked, in one scan: the rows of ``union_sources`` over :func:`one_feed` of each."""
    return spark.read.schema(f"{_columns(spec, spec.sources)}, `{spec.source_tag}` STRING").parquet(path).select(*spec.columns)
