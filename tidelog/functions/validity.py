"""Predicates over validity intervals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.config import EntitySpec


def valid_on(spec: EntitySpec, day: dt.date) -> Column:
    """True for the version in force on ``day``; an open interval has no end.

    Same as ``day BETWEEN from AND COALESCE(to, <end of time>)``, written as plain comparisons so
    that Parquet can use them. A version starts on its event day, the partition column of the
    stored history: repeating the bound on it prunes partitions.
    """
    on = F.lit(day)
    return (
        (F.col(spec.event_day) <= on)
        & (F.col(spec.valid_from) <= on)
        & (F.col(spec.valid_to).isNull() | (F.col(spec.valid_to) >= on))
    )
