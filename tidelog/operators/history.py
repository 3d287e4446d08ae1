"""Validity intervals over daily states, and reading the history as of a day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.config import EntitySpec
from tidelog.functions.validity import valid_on


def scd2(daily: DataFrame, spec: EntitySpec) -> DataFrame:
    """A version holds from its day to the eve of the key's next one; the last stays open.

    Directly after ``daily_state`` this reuses its shuffle and its sort.
    """
    versions = Window.partitionBy(spec.key).orderBy(spec.event_day)
    following = F.lead(spec.event_day).over(versions)
    ended = daily.withColumn(spec.valid_to, F.date_sub(following, 1))
    business = [c for c in daily.columns if c != spec.fingerprint]
    return ended.select(
        *business,
        F.col(spec.event_day).alias(spec.valid_from),
        spec.valid_to,
        F.col(spec.valid_to).isNull().alias(spec.is_current),
    )


def as_of(history: DataFrame, spec: EntitySpec, day: dt.date) -> DataFrame:
    """The version of each key in force on ``day``."""
    return history.filter(valid_on(spec, day))
