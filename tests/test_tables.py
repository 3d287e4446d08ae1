"""The given tables as feeds and purchases."""

from __future__ import annotations

from tidelog.operators.timeline import union_sources
from tidelog.plans.tables import FEEDS, USER, change_feeds, change_log, table

SF_DIR = "/root/testdata/sf0.001"


def test_one_scan_equals_the_union_of_the_feeds(spark):
    stacked = union_sources(change_feeds(spark, SF_DIR), USER)
    log = change_log(spark, SF_DIR)
    assert log.columns == stacked.columns == USER.columns
    assert log.exceptAll(stacked).count() == stacked.exceptAll(log).count() == 0


def test_feeds_cover_the_whole_table(spark):
    events = table(spark, SF_DIR, "events")
    assert {row.event_type for row in events.select("event_type").distinct().collect()} == set(FEEDS)
    purchases = events.filter("event_type = 'purchase'").count()
    assert change_log(spark, SF_DIR).count() == events.count() + purchases


def test_hours_do_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    expected = change_log(spark, SF_DIR).collect()
    try:
        for zone in ("Asia/Kolkata", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert change_log(spark, SF_DIR).collect() == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert all(row.event_time.minute == row.event_time.second == 0 for row in expected)
