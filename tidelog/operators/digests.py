"""Digests of what is known of each day: two histories are compared by a few numbers, and row by row only where these differ."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.config import EntitySpec
from tidelog.operators.checks import business_columns

DIGEST = ["versions", "sum_a", "sum_b"]


def day_digests(history: DataFrame, spec: EntitySpec) -> DataFrame:
    """``(day, versions, sum_a, sum_b)``: number of versions that start on a day and two sums of 64-bit hashes of their
    business columns. Independent of order and partitioning; a row for each day is all that is shuffled."""
    row = [F.col(c) for c in business_columns(spec)]
    # Sums of decimals cannot overflow: 2**63 versions of a day would be needed.
    total = lambda *marks: F.sum(F.xxhash64(*marks, *row).cast("decimal(38,0)"))
    return history.groupBy(spec.event_day).agg(
        F.count(F.lit(1)).alias("versions"), total(F.lit(1)).alias("sum_a"), total(F.lit("b")).alias("sum_b")
    )


def differing_days(left: DataFrame, right: DataFrame, spec: EntitySpec) -> list[dt.date | None]:
    """Days whose digests are not the same on both sides. No more than there are in a calendar."""
    signed = left.select(spec.event_day, *DIGEST, F.lit(1).alias("_sign")).unionByName(
        right.select(spec.event_day, *DIGEST, F.lit(-1).alias("_sign"))
    )
    net = signed.groupBy(spec.event_day, *DIGEST).agg(F.sum("_sign").alias("_net")).where("_net != 0")
    return list({r[0] for r in net.select(spec.event_day).collect()})
