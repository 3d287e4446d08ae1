"""Random change logs against a slow, obvious implementation.

Many small cases share one job, a key each. Times tie often, days skip, events repeat, values are
NULL as often as not, and texts contain what the fingerprint uses as separator and NULL mark.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import random
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidelog.config import EntitySpec, MetricSpec, SourceSpec
from tidelog.operators.history import as_of, scd2
from tidelog.operators.revenue import gmv_as_of, gmv_current
from tidelog.operators.state import (
    block_forward_fill,
    collapse_days,
    daily_state,
    daily_state_of_events,
    with_day_sources,
)
from tidelog.operators.timeline import latest_per_source_day, unify, with_fingerprint
from tidelog.plans.history import check_past_frozen, history_of

_KEYS = {"at": "TIMESTAMP_NTZ", "day": "DATE", "id": "BIGINT"}
SPEC = EntitySpec(
    key="id",
    event_time="at",
    event_day="day",
    source_tag="feed",
    fingerprint="hash",
    day_sources="feeds",
    valid_from="start",
    valid_to="end",
    is_current="open",
    timeline_table="timeline",
    daily_table="daily",
    history_table="history",
    sources=(
        SourceSpec("paid", _KEYS | {"amount": "DECIMAL(18,2)", "on": "DATE"}, ("amount", "on")),
        SourceSpec("about", _KEYS | {"n": "INT", "word": "STRING", "unit": "STRING"},
                   ("n", "word", "unit")),
        SourceSpec("extra", _KEYS | {"note": "STRING"}, ("note",)),
    ),
)
METRIC = MetricSpec(paid_day="on", segment="unit", amount="amount", missing_segment="none")
OWNED = {source.name: source.owned for source in SPEC.sources}
TEXTS = [None, "", "a", "b", "||", "a||b", "<null>", "<null>||<null>"]
FIRST = dt.date(2024, 2, 27)


def _random_events(seed: int, keys: int = 150) -> list[dict]:
    rng = random.Random(seed)
    events = []
    for key in [None, *range(keys)]:
        for _ in range(rng.randint(1, 14)):
            day = FIRST + dt.timedelta(days=rng.choice([0, 1, 2, 3, 9]))
            feed = rng.choice(list(OWNED))
            event = dict.fromkeys([column for owned in OWNED.values() for column in owned])
            event |= {
                "at": dt.datetime.combine(day, dt.time(rng.choice([0, 12, 23]))),
                "day": day,
                "id": key,
                "feed": feed,
            }
            if feed == "paid":
                event["amount"] = rng.choice([None, Decimal("1.00"), Decimal("2.50")])
                event["on"] = rng.choice([None, FIRST, FIRST + dt.timedelta(days=1)])
            elif feed == "about":
                event["n"] = rng.choice([None, 1])
                event["word"] = rng.choice(TEXTS)
                event["unit"] = rng.choice(TEXTS)
            else:
                event["note"] = rng.choice(TEXTS)
            events += [event] * rng.choice([1, 1, 1, 2, 3])
    rng.shuffle(events)
    return events


def _hash(event: dict) -> str:
    cells = ["<null>" if event[c] is None else str(event[c]) for c in sorted(SPEC.columns)]
    return hashlib.sha256("||".join(cells).encode()).hexdigest()


def _nulls_low(value):
    return (value is not None, value or "")


def _order(event: dict) -> tuple:
    return event["at"], _hash(event), *[_nulls_low(event[c]) for c in SPEC.text_columns]


def _versions(events: list[dict]) -> list[dict]:
    """Replay each key's events in order, noting the state at the end of every day."""
    by_key = defaultdict(list)
    for event in events:
        by_key[event["id"]].append(event)
    versions = []
    for key, own in by_key.items():
        state = dict.fromkeys(column for owned in OWNED.values() for column in owned)
        states = {}
        for event in sorted(own, key=_order):
            state |= {column: event[column] for column in OWNED[event["feed"]]}
            spoke = states.get(event["day"], {}).get("feeds", set()) | {event["feed"]}
            states[event["day"]] = {
                **state, "id": key, "at": event["at"], "day": event["day"],
                "hash": _hash(event), "feeds": spoke,
            }
        days = sorted(states)
        for day, following in zip(days, [*days[1:], None], strict=True):
            end = following and following - dt.timedelta(days=1)
            versions.append(
                {**states[day], "feeds": sorted(states[day]["feeds"]),
                 "start": day, "end": end, "open": end is None}
            )
    return versions


def _rows(frame, columns):
    return sorted(str([row[c] for c in columns]) for row in frame.collect())


def _expected(versions, columns):
    return sorted(str([version[c] for c in columns]) for version in versions)


@pytest.fixture(scope="module", params=[1, 2])
def case(spark, request):
    events = _random_events(request.param)
    types = {**_KEYS, "feed": "STRING"}
    for source in SPEC.sources:
        types |= source.schema
    ddl = ", ".join(f"`{column}` {types[column]}" for column in SPEC.columns)
    frame = spark.createDataFrame([tuple(e[c] for c in SPEC.columns) for e in events], ddl)
    return events, frame.repartition(5).cache(), _versions(events)


def test_fingerprints(case):
    events, frame, _ = case
    got = {row["hash"] for row in with_fingerprint(frame, SPEC).collect()}
    assert got == {_hash(event) for event in events}


def test_latest_per_source_day(case):
    events, frame, _ = case
    newest = {}
    for event in sorted(events, key=_order):
        newest[event["id"], event["feed"], event["day"]] = event
    timeline = latest_per_source_day(with_fingerprint(frame, SPEC), SPEC)
    assert _rows(timeline, SPEC.columns) == _expected(newest.values(), SPEC.columns)
    feeds = {name: frame.filter(F.col("feed") == name) for name in OWNED}
    assert _rows(unify(feeds, SPEC), SPEC.columns) == _expected(newest.values(), SPEC.columns)


def test_daily_states_three_ways(case):
    _, frame, versions = case
    hashed = with_fingerprint(frame, SPEC)
    timeline = latest_per_source_day(hashed, SPEC)
    columns = ["id", "day", "at", "hash", *SPEC.owned_columns, "feeds"]
    expected = _expected(versions, columns)
    assert _rows(daily_state(timeline, SPEC), columns) == expected
    assert _rows(daily_state_of_events(hashed, SPEC), columns) == expected
    assert _rows(collapse_days(block_forward_fill(timeline, SPEC), SPEC), columns) == expected
    tagged = with_day_sources(timeline, SPEC).select("id", "day", "feeds").distinct()
    assert _rows(tagged, ["id", "day", "feeds"]) == _expected(versions, ["id", "day", "feeds"])


def test_history(case):
    _, frame, versions = case
    columns = ["id", "day", "at", *SPEC.owned_columns, "feeds", "start", "end", "open"]
    expected = _expected(versions, columns)
    assert _rows(history_of(frame, SPEC), columns) == expected
    timeline = latest_per_source_day(with_fingerprint(frame, SPEC), SPEC)
    assert _rows(scd2(daily_state(timeline, SPEC), SPEC), columns) == expected


@pytest.mark.parametrize("after", [-1, 0, 2, 5, 30])
def test_history_and_revenue_as_of_a_day(case, after):
    _, frame, versions = case
    day = FIRST + dt.timedelta(days=after)
    valid = [v for v in versions if v["start"] <= day and (v["end"] is None or v["end"] >= day)]
    history = history_of(frame, SPEC)
    assert _rows(as_of(history, SPEC, day), ["id", "start"]) == _expected(valid, ["id", "start"])
    assert check_past_frozen(frame, SPEC, day).first().violations == 0
    _assert_revenue(gmv_as_of(history, SPEC, METRIC, day), valid)


def test_current_revenue(case):
    _, frame, versions = case
    history = history_of(frame, SPEC)
    _assert_revenue(gmv_current(history, SPEC, METRIC), [v for v in versions if v["open"]])


def _assert_revenue(result, versions):
    sums = {}
    for version in versions:
        if version["on"] is not None:
            group = version["on"], "none" if version["unit"] is None else version["unit"]
            so_far = sums.setdefault(group, None)
            if version["amount"] is not None:
                sums[group] = (so_far or 0) + version["amount"]
    assert [tuple(row) for row in result.collect()] == [
        (*group, sums[group]) for group in sorted(sums)
    ]
