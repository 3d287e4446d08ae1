"""Daily revenue per segment from a history. A paid version without amount sums to NULL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.config import EntitySpec, MetricSpec
from tidelog.operators.history import as_of

# Result columns.
DAY, SEGMENT, REVENUE = "dia", "subsidiaria", "gmv"


def _paid_by(versions: DataFrame, metric: MetricSpec, segment: Column) -> DataFrame:
    return (
        versions.filter(F.col(metric.paid_day).isNotNull())
        .groupBy(F.col(metric.paid_day).alias(DAY), segment.alias(SEGMENT))
        .agg(F.sum(metric.amount).alias(REVENUE))
    )


def _named(metric: MetricSpec) -> Column:
    return F.coalesce(F.col(metric.segment), F.lit(metric.missing_segment))


def gmv_current(history: DataFrame, spec: EntitySpec, metric: MetricSpec) -> DataFrame:
    """As known today. Versions without a segment count under the missing label."""
    paid = _paid_by(history.filter(spec.is_current), metric, _named(metric))
    return paid.orderBy(DAY, SEGMENT)


def gmv_as_of(
    history: DataFrame, spec: EntitySpec, metric: MetricSpec, day: dt.date
) -> DataFrame:
    """As known on ``day``; a payment date already known then counts even if it lies later."""
    paid = _paid_by(as_of(history, spec, day), metric, _named(metric))
    return paid.orderBy(DAY, SEGMENT)


def gmv_null_group(history: DataFrame, spec: EntitySpec, metric: MetricSpec) -> DataFrame:
    """As known today, unordered, with a missing segment as its own NULL group."""
    return _paid_by(history.filter(spec.is_current), metric, F.col(metric.segment))
