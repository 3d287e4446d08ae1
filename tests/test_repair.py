"""Late events into stored layers, publishing after a check, digests of a frozen past, exact sets of days."""

from __future__ import annotations

import datetime as dt
import os
from pathlib import Path

import golden
import pytest
from pyspark.sql import functions as F

from tidelog.config import PURCHASE
from tidelog.functions.days import day_set, days_of
from tidelog.operators.checks import check_same_versions
from tidelog.operators.digests import day_digests, differing_days
from tidelog.operators.history import as_of, scd2
from tidelog.operators.state import daily_state
from tidelog.operators.timeline import counted_timeline, latest_per_source_day, unify, union_sources, with_fingerprint
from tidelog.plans.history import check_past_frozen, history_of
from tidelog.plans.layers import Layers, build_daily, build_history, stored_layer
from tidelog.plans.publish import InvariantViolated, publish, published_digests, read_published
from tidelog.plans.refresh import refresh_layers
from tidelog.sources.events import MALFORMED, REASON, typed_events
from tidelog.sources.pointers import current_folder
from tidelog.sources.tables import write_days

DAY = PURCHASE.event_day


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("raw")
    for name, text in golden.feeds().items():
        (base / name).mkdir()
        (base / name / "events.csv").write_text(text, encoding="utf-8")
    feeds = {name: f.drop(MALFORMED, REASON) for name, f in typed_events(spark, str(base), PURCHASE).items()}
    return union_sources(feeds, PURCHASE).cache()


def event(spark, feed, key, time, **values):
    """One event of a feed; ``time`` None is an undated one."""
    kinds = {c: k for s in PURCHASE.sources for c, k in s.schema.items() if c in s.owned}
    row = spark.createDataFrame([(time and dt.datetime.fromisoformat(time), key, feed)], "t timestamp_ntz, k bigint, f string")
    return row.select(
        F.col("t").alias(PURCHASE.event_time), F.to_date("t").alias(DAY), F.col("k").alias(PURCHASE.key), F.col("f").alias(PURCHASE.source_tag),
        *[F.lit(values.get(c)).cast(kind).alias(c) for c, kind in kinds.items()],
    ).select(*PURCHASE.columns)


def built(spark, base, log) -> Layers:
    layers = Layers(str(base), PURCHASE)
    write_days(latest_per_source_day(with_fingerprint(log, PURCHASE), PURCHASE), layers.timeline, DAY)
    build_daily(spark, layers)
    build_history(spark, layers)
    return layers


def tables(spark, layers) -> dict:
    paths = {PURCHASE.timeline_table: layers.timeline, PURCHASE.daily_table: layers.daily, PURCHASE.history_table: layers.history}
    return {name: stored_layer(spark, layers, name, path) for name, path in paths.items()}


def same(left, right) -> bool:
    return left.exceptAll(right.select(*left.columns)).isEmpty() and right.select(*left.columns).exceptAll(left).isEmpty()


def files(path) -> dict[str, set]:
    return {d.name: {(f.name, os.stat(f).st_mtime_ns) for f in d.glob("*.parquet")} for d in Path(path).glob(f"{DAY}=*")}


LATE = {
    "new days": [
        # Between two versions, before and after everything that is known, of a new key, without a time, without a key.
        ("purchase_extra_info", 55, "2023-02-20 10:00:00", {"subsidiary": "internacional"}),
        ("product_item", 70, "2022-01-01 10:00:00", {"product_id": 9, "purchase_value": "1.00"}),
        ("product_item", 71, "2024-01-01 10:00:00", {"product_id": 9, "purchase_value": "1.00"}),
        ("purchase_extra_info", 4711, "2023-01-23 23:59:59", {"subsidiary": "x"}),
        ("purchase_extra_info", 73, None, {"subsidiary": "x"}),
        ("purchase", None, "2023-02-01 10:00:00", {"buyer_id": 5}),
    ],
    "a cancellation carried until the feed speaks again, and an event that loses its day": [
        ("purchase", 55, "2023-02-01 10:00:00", {"buyer_id": 1, "release_date": None}),
        ("purchase_extra_info", 55, "2023-01-23 00:00:01", {"subsidiary": "x"}),
        ("purchase", 72, "2023-02-01 10:00:00", {"buyer_id": 5}),
    ],
    "an event that wins its day, and several days of a key": [
        ("purchase_extra_info", 55, "2023-01-23 23:59:59", {"subsidiary": "x"}),
        ("purchase_extra_info", 55, "2023-03-01 10:00:00", {"subsidiary": "x"}),
        ("purchase_extra_info", 55, "2023-06-01 10:00:00", {"subsidiary": "y"}),
    ],
}


@pytest.mark.parametrize("case", LATE)
def test_late_events_give_what_a_full_rebuild_gives(spark, tmp_path, events, case):
    late = None
    for feed, key, time, values in LATE[case]:
        one = event(spark, feed, key, time, **values)
        late = one if late is None else late.unionByName(one)
    layers = built(spark, tmp_path / "refreshed", events)
    before = {name: files(path) for name, path in (("timeline", layers.timeline), ("daily", layers.daily), ("history", layers.history))}
    rewritten = refresh_layers(spark, layers, late)
    expected = tables(spark, built(spark, tmp_path / "rebuilt", events.unionByName(late)))
    for name, stored in tables(spark, layers).items():
        assert same(stored, expected[name]), name
    for (name, path), days in zip((("timeline", layers.timeline), ("daily", layers.daily), ("history", layers.history)), rewritten.values(), strict=True):
        folders = {f"{DAY}={'__HIVE_DEFAULT_PARTITION__' if d is None else d}" for d in days}
        after = files(path)
        assert {d for d in after if after[d] != before[name].get(d)} == folders
    assert refresh_layers(spark, layers, late) == {name: [] for name in rewritten}


def test_what_is_known_already_rewrites_nothing(spark, tmp_path, events):
    layers = built(spark, tmp_path, events)
    assert all(days == [] for days in refresh_layers(spark, layers, events).values())
    assert all(days == [] for days in refresh_layers(spark, layers, events.limit(0)).values())


def test_only_days_that_change_are_rewritten(spark, tmp_path, events):
    """55 moves to another subsidiary in February: the version of that day is new, the one before ends earlier, later ones carry it."""
    layers = built(spark, tmp_path, events)
    late = event(spark, "purchase_extra_info", 55, "2023-02-20 10:00:00", subsidiary="internacional")
    rewritten = refresh_layers(spark, layers, late)
    assert rewritten[PURCHASE.timeline_table] == [dt.date(2023, 2, 20)]
    before, after = dt.date(2023, 2, 5), dt.date(2023, 7, 15)
    assert sorted(rewritten[PURCHASE.history_table])[0] >= dt.date(2023, 1, 23)
    assert before in rewritten[PURCHASE.history_table] and after in rewritten[PURCHASE.history_table]
    assert before not in rewritten[PURCHASE.daily_table]


def test_counts_travel_with_the_timeline(events):
    counted = counted_timeline(events, PURCHASE)
    sums = counted.agg(F.sum("_stacked"), F.sum("_deduplicated"), F.count("*")).first()
    assert tuple(sums) == (39, 38, 36)
    plain = latest_per_source_day(with_fingerprint(events, PURCHASE), PURCHASE)
    assert same(plain, counted.drop("_stacked", "_deduplicated"))


# Publishing


def test_readers_see_the_old_history_until_the_new_one_is_checked(spark, tmp_path, events):
    path, history = f"{tmp_path}/gold", history_of(events, PURCHASE)
    with pytest.raises(FileNotFoundError):
        read_published(spark, path, history.schema, PURCHASE)
    counts = publish(history, path, PURCHASE)
    assert (counts["rows"], counts["broken_intervals"], counts["not_one_current"]) == (22, 0, 0)
    reader = read_published(spark, path, history.schema, PURCHASE)
    assert same(history, reader)

    for broken, expected in (
        (history.withColumn("is_current", F.lit(True)), {"broken_intervals": 0, "not_one_current": 6}),
        (history.withColumn("dt_fim_validade", F.date_add("dt_fim_validade", 1)), {"broken_intervals": 12, "not_one_current": 0}),
    ):
        with pytest.raises(InvariantViolated) as raised:
            publish(broken, path, PURCHASE)
        assert raised.value.violations == expected
        assert same(history, read_published(spark, path, history.schema, PURCHASE))
    # Nothing of what was refused is left: one history with its digests.
    assert len(list(Path(path).glob("v-*"))) == 2

    later = history_of(events.unionByName(event(spark, "purchase_extra_info", 55, "2024-05-05 10:00:00", subsidiary="x")), PURCHASE)
    publish(later, path, PURCHASE)
    # One who has the old history open still reads it whole, a new reader gets the new one.
    assert reader.count() == 22 and read_published(spark, path, history.schema, PURCHASE).count() == 23
    publish(later, path, PURCHASE)
    assert len(list(Path(path).glob("v-*"))) == 4


def test_a_reader_during_a_rebuild_sees_the_old_history(spark, tmp_path, events):
    """The rebuild looks, from within its own tasks, for what is published: the folder of before, until the very end."""
    path, history = f"{tmp_path}/gold", history_of(events, PURCHASE)
    publish(history, path, PURCHASE)
    old = current_folder(spark, path)
    seen = tmp_path / "seen"

    def look(batches):
        seen.write_text((Path(path) / "CURRENT").read_text())
        yield from batches

    publish(history.mapInArrow(look, history.schema), path, PURCHASE)
    assert old.endswith(seen.read_text()) and current_folder(spark, path) != old


def test_a_rebuild_that_fails_leaves_the_old_history(spark, tmp_path, events):
    path, history = f"{tmp_path}/gold", history_of(events, PURCHASE)
    publish(history, path, PURCHASE)
    fails = history.withColumn("subsidiary", F.when(F.col(PURCHASE.key) == 55, F.raise_error(F.lit("lost")).cast("string")))
    with pytest.raises(Exception, match="lost"):
        publish(fails, path, PURCHASE)
    assert same(history, read_published(spark, path, history.schema, PURCHASE))


def test_checks_take_no_shuffle_of_their_own(spark, tmp_path, events):
    from tidelog.plans.publish import with_violations

    write_days(unify_rows(events), f"{tmp_path}/t", DAY)
    stored = spark.read.parquet(f"{tmp_path}/t")
    checked = with_violations(scd2(daily_state(stored, PURCHASE), PURCHASE), PURCHASE)
    assert checked._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def unify_rows(events):
    return latest_per_source_day(with_fingerprint(events, PURCHASE), PURCHASE)


# Frozen past


def test_undated_events_are_no_violation(spark):
    rows = (
        event(spark, "product_item", 1, None, purchase_value="7.00")
        .unionByName(event(spark, "purchase", 1, "2023-01-05 10:00:00", buyer_id=3))
        .unionByName(event(spark, "purchase", 1, "2023-03-05 10:00:00", buyer_id=4))
    )
    for day in ("2023-01-01", "2023-01-05", "2023-02-01", "2024-01-01"):
        assert check_past_frozen(rows, PURCHASE, dt.date.fromisoformat(day)).first().violations == 0
    # A version without a start is in force on no day; its values are, in the versions after it.
    history = history_of(rows, PURCHASE)
    assert as_of(history, PURCHASE, dt.date(2023, 1, 4)).count() == 0
    assert str(as_of(history, PURCHASE, dt.date(2023, 1, 5)).first().purchase_value) == "7.00"


def test_digests_show_which_days_differ(spark, events):
    day = dt.date(2023, 6, 1)
    known = events.where(F.col(DAY) <= F.lit(day))
    then = history_of(known, PURCHASE)
    digests = day_digests(then, PURCHASE)
    assert differing_days(digests, day_digests(then.repartition(7), PURCHASE), PURCHASE) == []
    assert check_past_frozen(events, PURCHASE, day, then, digests).first().violations == 0
    # An event that was not known then appears in the past: the versions it changes are reported.
    backdated = events.unionByName(event(spark, "purchase_extra_info", 55, "2023-02-20 10:00:00", subsidiary="x"))
    now = history_of(backdated, PURCHASE).where(F.col("dt_inicio_validade") <= F.lit(day))
    days = differing_days(digests, day_digests(now, PURCHASE), PURCHASE)
    assert dt.date(2023, 2, 20) in days
    expected = check_same_versions(then, now, PURCHASE).first().violations
    assert check_past_frozen(backdated, PURCHASE, day, then, digests).first().violations == expected > 0


def test_a_published_history_brings_the_digests_of_its_past(spark, tmp_path, events):
    path, day = f"{tmp_path}/gold", dt.date(2023, 6, 1)
    then = history_of(events.where(F.col(DAY) <= F.lit(day)), PURCHASE)
    publish(then, path, PURCHASE)
    published, digests = read_published(spark, path, then.schema, PURCHASE), published_digests(spark, path)
    assert check_past_frozen(events, PURCHASE, day, published, digests).first().violations == 0
    backdated = events.unionByName(event(spark, "purchase_extra_info", 55, "2023-02-20 10:00:00", subsidiary="x"))
    assert check_past_frozen(backdated, PURCHASE, day, published, digests).first().violations > 0


def test_sets_of_days_are_exact(spark):
    days = [dt.date(1970, 1, 1), dt.date(1969, 12, 31), dt.date(2059, 9, 18), dt.date(2059, 9, 19), dt.date(1, 1, 1), dt.date(9999, 12, 31), None]
    days += [dt.date(2024, 1, 1) + dt.timedelta(days=i * i) for i in range(50)]
    rows = spark.createDataFrame([(d,) for d in days * 3], "day DATE").repartition(9)
    found = rows.agg(*[c.alias(n) for n, c in day_set("day").items()]).first()
    assert days_of(found.asDict()) == set(days)
    none = rows.limit(0).agg(*[c.alias(n) for n, c in day_set("day").items()]).first()
    assert days_of(none.asDict()) == set()
