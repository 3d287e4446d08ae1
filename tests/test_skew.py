"""A third of all rows on one key, on one key and day, on one feed, on one item: same results, and
no group larger than the calendar."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from tidelog.operators.state import fold_days
from tidelog.operators.timeline import latest_per_source_day, with_fingerprint
from tidelog.plans.tables import USER, change_log

SOURCE = "/root/testdata/sf0.01"

# A third of the events go to user 0; of these, every second one falls on one day, and a third of
# all events are purchases with the same content, that is, copies of one event.
EVENTS = f"""
SELECT event_id,
       CASE WHEN event_id % 3 = 2 THEN TIMESTAMP '2024-01-10 09:30:00'
            WHEN event_id % 6 = 0 THEN TIMESTAMP '2024-01-12' + (event_id % 80000) * INTERVAL 1 SECOND
            ELSE ts END AS ts,
       CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 3 = 2 THEN 1 ELSE user_id END AS user_id,
       CASE WHEN event_id % 3 = 2 THEN 'purchase' ELSE event_type END AS event_type,
       CASE WHEN event_id % 3 = 2 THEN 10.5 ELSE value END AS value,
       CASE WHEN event_id % 3 = 2 THEN '{{"k": 50}}' ELSE props END AS props
FROM '{SOURCE}/events.parquet'"""
# A third of the lines belong to order 1, and to one supplier and one part each.
LINES = f"""
SELECT * REPLACE (CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE l_orderkey END AS l_orderkey,
                  CASE WHEN l_orderkey % 3 = 1 THEN 7 ELSE l_suppkey END AS l_suppkey,
                  CASE WHEN l_orderkey % 3 = 2 THEN 9 ELSE l_partkey END AS l_partkey)
FROM '{SOURCE}/lineitem.parquet'"""
# A third of the orders buy item 1 as well, so both sides of the join have one huge key.
ORDERS = f"""
SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_orderkey END AS o_orderkey,
                  CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 5 ELSE o_custkey END AS o_custkey)
FROM '{SOURCE}/orders.parquet'"""

QUERIES = [
    "source_day_counts",
    "dedup_resent_events",
    "latest_per_source_day",
    "block_forward_fill",
    "daily_state",
    "daily_state_of_events",
    "scd2_history",
    "gmv_daily_current",
    "gmv_daily_asof",
    "stage_counts",
    "check_past_frozen",
    "partition_refresh",
    "top50_producers_year",
    "top50_producers_by_order",
    "top2_products_per_producer",
]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    base = tmp_path_factory.mktemp("skewed")
    duck = duckdb.connect()
    for name, query in {"events": EVENTS, "lineitem": LINES, "orders": ORDERS}.items():
        file = base / f"{name}.parquet"
        duck.execute(f"COPY ({query}) TO '{file}' (FORMAT parquet)")
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{file}'")
    return str(base), duck


@pytest.mark.parametrize("name", QUERIES)
def test_skewed_tables_match_sql(spark, skewed, name):
    sf_dir, duck = skewed
    got = queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    cursor = duck.execute(oracle_sql()[name])
    delivered = [column[0] for column in cursor.description]
    picks = [delivered.index(column) for column in columns]
    expected = Counter(tuple(row[i] for i in picks) for row in cursor.fetchall())
    assert Counter(tuple(row) for row in got.select(*columns).collect()) == expected


def test_the_tables_are_skewed(spark, skewed):
    log = change_log(spark, skewed[0])
    total = log.count()
    assert log.groupBy("entity").count().agg(F.max("count")).first()[0] > total / 3
    assert log.groupBy(*log.columns).count().agg(F.max("count")).first()[0] > total / 3


def test_no_key_outgrows_the_calendar(spark, skewed):
    events = with_fingerprint(change_log(spark, skewed[0]), USER)
    days = events.select(F.countDistinct("event_day")).first()[0]

    def largest(frame):
        return frame.groupBy("entity").count().agg(F.max("count")).first()[0]

    assert largest(fold_days(events, USER)) <= days
    assert largest(latest_per_source_day(events, USER)) <= days * len(USER.sources)
