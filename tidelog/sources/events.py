"""Reading raw change feeds: CSV with a header, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.config import EntitySpec, SourceSpec

MALFORMED, REASON = "_malformed", "_reason"


def read_events(spark: SparkSession, path: str, source: SourceSpec) -> DataFrame:
    """The feed as delivered, plus the raw line in ``_malformed`` where a cell did not parse.

    Such a cell reads as NULL and its row stays. Only the columns a query needs are converted, so
    only those can turn out malformed. The whole header is checked: without that, Spark matches
    columns by position and a reordered file loads silently wrong.
    """
    return (
        spark.read.schema(f"{source.ddl}, {MALFORMED} STRING")
        .option("header", True)
        .option("enforceSchema", False)
        .option("columnPruning", False)
        .option("columnNameOfCorruptRecord", MALFORMED)
        .csv(path)
    )


def with_reason(events: DataFrame, source: SourceSpec) -> DataFrame:
    """Say of each malformed line which of its cells are not of their column's type, or that it has too few or too many."""
    cells = F.from_csv(F.col(MALFORMED), ", ".join(f"`{column}` STRING" for column in source.schema))
    wrong = [
        F.when(cells[column].isNotNull() & F.col(f"`{column}`").isNull(), F.lit(f"{column} is no {kind}"))
        for column, kind in source.schema.items()
    ]
    which = F.concat_ws("; ", *wrong)
    reason = F.when(which == "", F.lit("wrong number of cells")).otherwise(which)
    return events.withColumn(REASON, F.when(F.col(MALFORMED).isNotNull(), reason))


def with_event_day(events: DataFrame, spec: EntitySpec) -> DataFrame:
    """Derive the day from the event time; a delivered day is redundant and not trusted."""
    return events.withColumn(spec.event_day, F.to_date(spec.event_time))


def typed_events(spark: SparkSession, path: str, spec: EntitySpec) -> dict[str, DataFrame]:
    """All feeds below ``path``, one folder per feed, with their derived day, and the line and the reason where a cell
    did not parse."""
    return {
        source.name: with_event_day(with_reason(read_events(spark, f"{path}/{source.name}", source), source), spec)
        for source in spec.sources
    }
