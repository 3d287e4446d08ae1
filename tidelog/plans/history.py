"""Plans that chain the operators: events to history, and its check against a shorter past."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.config import EntitySpec
from tidelog.operators.checks import VIOLATIONS, check_same_versions
from tidelog.operators.digests import day_digests, differing_days
from tidelog.operators.history import scd2
from tidelog.operators.state import daily_state_of_events
from tidelog.operators.timeline import with_fingerprint


def history_of(events: DataFrame, spec: EntitySpec) -> DataFrame:
    """History of stacked events without writing any layer: two shuffles.

    The first is by key and day, of rows already folded to one per group and task. The second is by
    key, where a key has no more rows than there are calendar days.
    """
    return scd2(daily_state_of_events(with_fingerprint(events, spec), spec), spec)


def known_by(events: DataFrame, spec: EntitySpec, day: dt.date) -> DataFrame:
    """Events up to the end of ``day``, and those without a time, which count from the beginning. The bound is on
    the time itself, so that it reaches the scan."""
    eve = F.lit(dt.datetime.combine(day + dt.timedelta(days=1), dt.time())).cast(events.schema[spec.event_time].dataType)
    return events.filter((F.col(spec.event_time) < eve) | F.col(spec.event_time).isNull())


def check_past_frozen(
    events: DataFrame, spec: EntitySpec, day: dt.date, then: DataFrame | None = None, digests: DataFrame | None = None
) -> DataFrame:
    """What was known by ``day`` must not depend on anything that happened later.

    ``then`` is the history as it was built by that day, and ``digests`` what :func:`day_digests` made of it; without them they are
    made from the events known by then. Both histories are compared by their digests; versions are compared only on days
    that differ, so a sound past costs no comparison of rows. Versions of undated events belong to either side.
    """
    then = history_of(known_by(events, spec, day), spec) if then is None else then
    now = history_of(events, spec).filter((F.col(spec.valid_from) <= F.lit(day)) | F.col(spec.valid_from).isNull())
    days = differing_days(day_digests(then, spec) if digests is None else digests, day_digests(now, spec), spec)
    if not days:
        return events.sparkSession.range(1).select(F.lit(0).cast("bigint").alias(VIOLATIONS))
    dated = [d for d in days if d is not None]
    differ = F.col(spec.event_day).isin(dated) if dated else F.lit(False)
    differ = differ | F.col(spec.event_day).isNull() if None in days else differ
    return check_same_versions(then.filter(differ), now.filter(differ), spec)
