"""What late events change in stored states and versions, computed for the keys they are about.

A late event changes its own day, the end of the version before it, and every later day that carries what its feed
said, until that feed speaks again. Everything earlier stays: states never look ahead. So a key is computed anew from its
first touched day on, seeded with the version in force on the eve of it, which holds the last block of every feed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.config import EntitySpec
from tidelog.operators.state import BLOCK, LAST, carry_blocks, fold_days, said_on_days
from tidelog.operators.timeline import latest_per_source_day, with_fingerprint

TOUCHED, TOUCHED_KEY = "_touched", "_touched_key"
_BEFORE_ALL = -(1 << 31)


def _at(day: str) -> Column:
    """Number of a day; events without one sort before all others."""
    return F.coalesce(F.unix_date(day), F.lit(_BEFORE_ALL))


def first_touched(late: DataFrame, spec: EntitySpec) -> DataFrame:
    """Each key of the late events with the number of the first day they touch. No key at all is a key as well."""
    return late.groupBy(F.col(spec.key).alias(TOUCHED_KEY)).agg(F.min(_at(spec.event_day)).alias(TOUCHED))


def _of_touched(rows: DataFrame, touched: DataFrame, spec: EntitySpec) -> DataFrame:
    """Rows of the touched keys. Of the others nothing goes further than this join."""
    return rows.join(touched, F.col(spec.key).eqNullSafe(F.col(TOUCHED_KEY)))


def from_touched_on(rows: DataFrame, touched: DataFrame, spec: EntitySpec) -> DataFrame:
    """Rows of the touched keys from their first touched day on."""
    return _of_touched(rows, touched, spec).where(_at(spec.event_day) >= F.col(TOUCHED)).drop(TOUCHED, TOUCHED_KEY)


def in_force_before(history: DataFrame, touched: DataFrame, spec: EntitySpec) -> DataFrame:
    """The version of each touched key that held on the eve of its first touched day."""
    held = F.col(spec.valid_to).isNull() | (F.unix_date(spec.valid_to) >= F.col(TOUCHED) - 1)
    before = _of_touched(history, touched, spec).where((_at(spec.event_day) < F.col(TOUCHED)) & held)
    return before.drop(TOUCHED, TOUCHED_KEY)


def renewed_timeline(timeline: DataFrame, late: DataFrame, touched: DataFrame, spec: EntitySpec) -> DataFrame:
    """Timeline rows of the touched keys from their first touched day on, with the late events in place. Late events
    that were known already change nothing."""
    known = from_touched_on(timeline, touched, spec).select(*spec.columns, spec.fingerprint)
    return latest_per_source_day(known.unionByName(with_fingerprint(late.select(*spec.columns), spec)), spec)


def renewed_states(timeline: DataFrame, before: DataFrame, spec: EntitySpec) -> DataFrame:
    """Daily states from renewed timeline rows, carried on from the versions in force before. These come along as rows
    without a fingerprint: no state is new there, but their intervals end where the next one starts."""
    seeds = before.select(
        spec.key,
        spec.event_day,
        F.struct(F.col(spec.event_time), F.lit(None).cast("string").alias(spec.fingerprint)).alias(LAST),
        spec.day_sources,
        *[F.struct(*source.owned).alias(BLOCK.format(source.name)) for source in spec.sources],
    )
    said = said_on_days(fold_days(timeline, spec), spec)
    return carry_blocks(said.unionByName(seeds), spec)


def changed(renewed: DataFrame, stored: DataFrame) -> DataFrame:
    """Renewed rows that are not stored as they are; NULLs are equal."""
    return renewed.select(*stored.columns).exceptAll(stored)
