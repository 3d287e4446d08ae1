"""Exact sets of days as an aggregate that can be merged and observed.

A set is a bitmap with a bit for each of the 32,768 days from 1970 on, which fits in one aggregation buffer of 4 KB
whatever the number of rows. Days before and after are kept as a plain set, so nothing is left out.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_FIRST = dt.date(1970, 1, 1)
_BITS = 1 << 15
BITS, OTHERS, UNDATED = "_day_bits", "_other_days", "_no_day"


def day_set(day: str) -> dict[str, Column]:
    """Aggregates whose values :func:`days_of` turns back into days."""
    number = F.unix_date(day).cast("bigint")
    inside = number.between(0, _BITS - 1)
    return {
        BITS: F.bitmap_construct_agg(F.when(inside, number)),
        OTHERS: F.collect_set(F.when(~inside, F.col(day))),
        UNDATED: F.count_if(F.col(day).isNull()),
    }


def days_of(found: Mapping[str, object]) -> set[dt.date | None]:
    """The days in the set, NULL among them if a row had none."""
    bits = bytes(found[BITS] or b"")
    days: set[dt.date | None] = {
        _FIRST + dt.timedelta(days=8 * at + bit) for at, byte in enumerate(bits) if byte for bit in range(8) if byte >> bit & 1
    }
    days.update(found[OTHERS] or ())
    if found[UNDATED]:
        days.add(None)
    return days
