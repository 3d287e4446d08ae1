"""The hand-checkable purchase rows through every operator, against the golden tables."""

from __future__ import annotations

import dataclasses
import datetime as dt
import itertools
from decimal import Decimal

import golden
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelog.config import GMV, PURCHASE
from tidelog.operators.checks import check_intervals, check_one_current
from tidelog.operators.counts import source_day_counts, stage_counts
from tidelog.operators.history import as_of, scd2
from tidelog.operators.revenue import gmv_as_of, gmv_current, gmv_null_group
from tidelog.operators.state import (
    block_forward_fill,
    collapse_days,
    daily_state,
    daily_state_of_events,
)
from tidelog.operators.timeline import (
    drop_resent,
    latest_per_source_day,
    unify,
    union_sources,
    with_fingerprint,
)
from tidelog.plans.history import check_past_frozen, history_of
from tidelog.plans.sql import gmv_as_of_sql, gmv_current_sql, register
from tidelog.sources.events import typed_events


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    base = tmp_path_factory.mktemp("raw")
    for name, text in golden.feeds().items():
        (base / name).mkdir()
        (base / name / "events.csv").write_text(text, encoding="utf-8")
    return str(base)


@pytest.fixture(scope="module")
def feeds(spark, raw):
    return typed_events(spark, raw, PURCHASE)


@pytest.fixture(scope="module")
def stacked(feeds):
    return with_fingerprint(union_sources(feeds, PURCHASE), PURCHASE).cache()


@pytest.fixture(scope="module")
def timeline(feeds):
    return unify(feeds, PURCHASE).cache()


@pytest.fixture(scope="module")
def history(timeline):
    return scd2(daily_state(timeline, PURCHASE), PURCHASE).cache()


def test_feeds_are_typed(feeds):
    assert {name: feed.count() for name, feed in feeds.items()} == {
        "purchase": 16,
        "product_item": 12,
        "purchase_extra_info": 11,
    }
    kinds = dict(feeds["product_item"].dtypes)
    assert kinds["transaction_datetime"] == "timestamp_ntz"
    assert kinds["transaction_date"] == "date"
    assert kinds["purchase_value"] == "decimal(18,2)"


def test_days_per_source(stacked):
    rows = source_day_counts(stacked, PURCHASE).collect()
    assert {tuple(row) for row in rows} == {
        ("purchase", 16, 13),
        ("product_item", 12, 12),
        ("purchase_extra_info", 11, 11),
    }


def test_canonical_columns(stacked):
    assert stacked.columns == [*PURCHASE.columns, "hash_evento"]
    assert len(PURCHASE.columns) == 13


def test_fingerprint_of_the_tied_events(stacked):
    tied = stacked.filter("purchase_id = 76 AND origem_evento = 'purchase'").collect()
    hashes = {row.buyer_id: row.hash_evento for row in tied}
    assert hashes[889900][:8] == "347066b5" and hashes[889900][-4:] == "80a0"
    assert hashes[889911][:8] == "5eee05d7" and hashes[889911][-4:] == "df37"


def test_rows_after_each_stage(stacked, timeline, history):
    deduplicated = drop_resent(stacked)
    daily = daily_state(timeline, PURCHASE)
    frames = [stacked, deduplicated, timeline, daily, history, history.filter("is_current")]
    expected = [39, 38, 36, 22, 22, 10]
    assert [frame.count() for frame in frames] == expected
    assert list(stage_counts(stacked, PURCHASE).first()) == expected


def test_resent_events_change_nothing(stacked, timeline):
    again = latest_per_source_day(drop_resent(stacked), PURCHASE)
    assert again.exceptAll(timeline).count() == timeline.exceptAll(again).count() == 0


def test_history_is_the_golden_one(history):
    expected = golden.table("History (derived;")
    columns = list(expected[0])
    rows = history.orderBy("purchase_id", "dt_inicio_validade").collect()
    assert golden.printed(rows, columns) == [tuple(row.values()) for row in expected]
    assert all(row.transaction_date == row.dt_inicio_validade for row in rows)


def test_folding_first_equals_filling_first(stacked, timeline):
    step_by_step = collapse_days(block_forward_fill(timeline, PURCHASE), PURCHASE)
    for folded in (daily_state(timeline, PURCHASE), daily_state_of_events(stacked, PURCHASE)):
        same = step_by_step.select(*folded.columns)
        assert folded.exceptAll(same).count() == same.exceptAll(folded).count() == 0


def test_filling_column_by_column_would_miss_a_cancellation(timeline, history):
    so_far = (
        Window.partitionBy("purchase_id")
        .orderBy("transaction_datetime", "hash_evento")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    by_column = timeline.withColumn("release_date", F.last("release_date", True).over(so_far))
    cancelled = by_column.filter("purchase_id = 72").orderBy(F.desc("transaction_datetime"))
    assert cancelled.first().release_date == dt.date(2023, 4, 4)
    by_block = block_forward_fill(timeline, PURCHASE).filter("purchase_id = 72")
    assert by_block.orderBy(F.desc("transaction_datetime")).first().release_date is None
    assert history.filter("purchase_id = 72 AND is_current").first().release_date is None


def test_current_revenue(spark, history):
    expected = [tuple(row.values()) for row in golden.table("Current GMV (published")]
    view = register(history, "purchase_historico")
    for result in (
        gmv_current(history, PURCHASE, GMV),
        gmv_current_sql(spark, view, PURCHASE, GMV),
    ):
        assert golden.printed(result.collect(), ["dia", "subsidiaria", "gmv"]) == expected


def test_revenue_as_known_on_a_day(spark, history):
    view = register(history, "purchase_historico")
    by_day = itertools.groupby(
        golden.table("GMV as known on a date"), key=lambda row: row["as of"]
    )
    for day, rows in by_day:
        expected = [(row["dia"], row["subsidiaria"], row["gmv"]) for row in rows]
        on = dt.date.fromisoformat(day)
        for result in (
            gmv_as_of(history, PURCHASE, GMV, on),
            gmv_as_of_sql(spark, view, PURCHASE, GMV, on),
        ):
            assert golden.printed(result.collect(), ["dia", "subsidiaria", "gmv"]) == expected


def test_existing_sql_runs_on_the_registered_history(spark, history):
    register(history, "purchase_historico")
    rows = spark.sql(
        """SELECT release_date, subsidiary, sum(purchase_value) AS total FROM purchase_historico
        WHERE date'2023-03-31' BETWEEN dt_inicio_validade
              AND coalesce(dt_fim_validade, date'9999-12-31') AND release_date IS NOT NULL
        GROUP BY ALL"""
    ).collect()
    same = gmv_as_of(history, PURCHASE, GMV, dt.date(2023, 3, 31)).collect()
    assert {tuple(row) for row in rows} == {tuple(row) for row in same}


def test_colliding_contents_are_two_events(spark):
    """NULL and its text print alike; both ways of finding re-sends take the contents apart."""
    rows = [(dt.datetime(2024, 1, 1), dt.date(2024, 1, 1), 1, "purchase_extra_info", text) for text in (None, "<null>", None)]
    names = [*PURCHASE.key_columns, "subsidiary"]
    events = spark.createDataFrame(rows, "a timestamp_ntz, b date, c bigint, d string, e string").toDF(*names)
    missing = {c: k for s in PURCHASE.sources for c, k in s.schema.items() if c in s.owned and c != "subsidiary"}
    events = events.select("*", *[F.lit(None).cast(k).alias(c) for c, k in missing.items()]).select(*PURCHASE.columns)
    counts = stage_counts(with_fingerprint(events, PURCHASE), PURCHASE).first()
    assert (counts.stacked, counts.deduplicated, drop_resent(events).count()) == (3, 2, 2)


def test_missing_segment_as_null_group(history):
    rows = {tuple(row) for row in gmv_null_group(history, PURCHASE, GMV).collect()}
    assert (dt.date(2023, 4, 18), None, Decimal("640.00")) in rows
    assert len(rows) == 8


def test_payment_without_amount_sums_to_null(spark):
    paid = spark.createDataFrame(
        [(dt.date(2023, 1, 1), "nacional", None, True)],
        "release_date DATE, subsidiary STRING, purchase_value DECIMAL(18,2), is_current BOOLEAN",
    )
    assert gmv_current(paid, PURCHASE, GMV).first().gmv is None


def test_one_version_per_key_on_any_day(history):
    for day in (dt.date(2023, 1, 31), dt.date(2023, 7, 13), dt.date(2024, 1, 1)):
        version = as_of(history, PURCHASE, day)
        assert version.groupBy("purchase_id").count().filter("count > 1").isEmpty()


def test_invariants_hold(stacked, history):
    events = stacked.drop("hash_evento")
    assert check_one_current(history, PURCHASE).first().violations == 0
    assert check_intervals(history, PURCHASE).first().violations == 0
    for day in (dt.date(2023, 2, 4), dt.date(2023, 6, 8)):
        assert check_past_frozen(events, PURCHASE, day).first().violations == 0


def test_checks_notice_broken_histories(history):
    reopened = history.withColumn("is_current", F.lit(True))
    assert check_one_current(reopened, PURCHASE).first().violations == 6
    shifted = history.withColumn("dt_fim_validade", F.date_add("dt_fim_validade", 1))
    assert check_intervals(shifted, PURCHASE).first().violations == 12
    left_open = history.withColumn("dt_fim_validade", F.lit(None).cast("date"))
    assert check_intervals(left_open, PURCHASE).first().violations == 12


def test_reruns_agree_whatever_the_partitioning(stacked, history):
    events = stacked.drop("hash_evento")
    for parts in (1, 5, 17):
        again = history_of(events.repartition(parts), PURCHASE)
        same = history.select(*again.columns)
        assert again.exceptAll(same).count() == same.exceptAll(again).count() == 0


def test_order_of_arrival_is_irrelevant(feeds, history):
    for order in itertools.permutations(PURCHASE.sources):
        spec = dataclasses.replace(PURCHASE, sources=order)
        again = scd2(daily_state(unify(feeds, spec), spec), spec).select(*history.columns)
        assert again.exceptAll(history).count() == history.exceptAll(again).count() == 0


def test_any_session_zone_gives_the_same_rows(spark, raw, history):
    columns = history.columns
    expected = {tuple(map(str, row)) for row in history.select(*columns).collect()}
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/Sao_Paulo", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            feeds = typed_events(spark, raw, PURCHASE)
            again = scd2(daily_state(unify(feeds, PURCHASE), PURCHASE), PURCHASE)
            assert {tuple(map(str, row)) for row in again.select(*columns).collect()} == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
