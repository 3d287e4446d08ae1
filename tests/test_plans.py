"""Shape of the physical plans: what is shuffled, how often, and what reaches the scan."""

from __future__ import annotations

import contextlib
import datetime as dt
import io
import re
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidelog.operators.history import as_of, scd2
from tidelog.operators.revenue import gmv_as_of, gmv_current
from tidelog.operators.state import daily_state
from tidelog.operators.timeline import union_sources
from tidelog.plans.levels import as_of_levels, read_levels, write_levels
from tidelog.plans.queries import QUERIES
from tidelog.plans.tables import USER, USER_GMV, change_log
from tidelog.plans.history import history_of, known_by
from tidelog.sources.feeds import all_feeds, one_feed, split_feeds
from tidelog.sources.tables import read_table, write_days

SF_DIR = "/root/testdata/sf0.001"
WRITING = {"csv_typed_scan", "layer_roundtrip", "partition_refresh", "layer_roundtrip_buckets", "chain_counts", "late_events_repaired"}


def plan(frame, mode="simple") -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain(mode)
    return out.getvalue()


def nodes(text: str, name: str) -> int:
    return len(re.findall(rf"[-:] {name}\b", text))


@pytest.fixture(scope="module")
def big_tables(spark):
    """Plan as for tables beyond any broadcast."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITING))
def test_no_pairwise_join_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert bad not in text


@pytest.mark.parametrize(
    ("name", "shuffles"),
    [
        ("event_fingerprint", 0),
        ("cdc_union_timeline", 0),
        ("latest_per_source_day", 1),
        ("dedup_resent_events", 1),
        ("block_forward_fill", 2),
        ("daily_state", 2),
        ("daily_state_of_events", 2),
        ("scd2_history", 2),
        ("history_as_of", 2),
        ("gmv_daily_null_group", 3),
        ("gmv_daily_current", 4),
        ("gmv_daily_asof", 4),
        ("stage_counts", 4),
        ("source_day_counts", 2),
        ("top50_producers_by_order", 1),
    ],
)
def test_number_of_shuffles(spark, name, shuffles):
    assert nodes(plan(QUERIES[name](spark, SF_DIR)), "Exchange") == shuffles


def test_events_are_read_once_for_a_history(spark):
    assert nodes(plan(QUERIES["scd2_history"](spark, SF_DIR)), "FileScan") == 1


def test_groups_are_reduced_before_the_shuffle(spark):
    folded = plan(QUERIES["scd2_history"](spark, SF_DIR))
    assert folded.count("partial_max") and nodes(folded, "SortAggregate") == 2
    newest = plan(QUERIES["latest_per_source_day"](spark, SF_DIR))
    assert nodes(newest, "WindowGroupLimit") == 2
    ranked = plan(QUERIES["top2_products_per_producer"](spark, SF_DIR))
    assert nodes(ranked, "WindowGroupLimit") == 2
    assert "partial_count" in ranked and "partial_sum" in ranked


def test_daily_state_and_history_share_one_shuffle_sort_and_window(spark, tmp_path):
    timeline = QUERIES["latest_per_source_day"](spark, SF_DIR)
    write_days(timeline, f"{tmp_path}/timeline", USER.event_day)
    stored = spark.read.parquet(f"{tmp_path}/timeline")
    text = plan(scd2(daily_state(stored, USER), USER))
    assert [nodes(text, n) for n in ("Exchange", "Sort", "Window")] == [1, 1, 1]


def test_top_k_keeps_k_rows_per_task(spark):
    assert "TakeOrderedAndProject(limit=50" in plan(QUERIES["top50_producers_year"](spark, SF_DIR))


def test_ranking_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["top50_producers_by_order"](spark, SF_DIR), "formatted")
    assert "EqualTo(o_orderstatus,F)" in text
    assert "GreaterThanOrEqual(o_orderdate,1997-01-01" in text
    assert "LessThan(o_orderdate,1998-01-01" in text
    assert "o_orderpriority" not in text


def test_large_rankings_join_by_sort_merge(spark, big_tables):
    text = plan(QUERIES["top2_products_per_producer"](spark, SF_DIR))
    assert nodes(text, "SortMergeJoin") == 1
    assert "Broadcast" not in text


def test_stored_history_is_pruned_by_day_and_column(spark, tmp_path):
    path = f"{tmp_path}/history"
    write_days(history_of(change_log(spark, SF_DIR), USER), path, USER.event_day)
    stored = spark.read.parquet(path)

    now = plan(gmv_current(stored, USER, USER_GMV), "formatted")
    assert "IsNotNull(paid_date)" in now and "EqualTo(is_current,true)" in now
    assert "ReadSchema: struct<amount:decimal(18,2),paid_date:date,segment:string,is_current" in now

    then = plan(gmv_as_of(stored, USER, USER_GMV, dt.date(2024, 1, 15)), "formatted")
    pruned = re.search(r"PartitionFilters: \[(.*)\]", then).group(1)
    assert "event_day" in pruned and "<= 2024-01-15" in pruned
    assert "LessThanOrEqual(valid_from,2024-01-15)" in then
    assert "Or(IsNull(valid_to),GreaterThanOrEqual(valid_to,2024-01-15))" in then


def test_state_of_a_day_is_found_in_a_few_cells(spark, tmp_path):
    """Folders read grow with the log of the days, not with the days; same rows as from the history itself."""
    read, stored_days = {}, {}
    for days in (64, 1024):
        rows = spark.range(days * 20).select(
            F.col("id").alias("entity"),
            F.expr(f"DATE'2020-01-01' + CAST(id % {days} AS INT)").alias("event_day"),
            F.expr(f"DATE'2020-01-01' + CAST(id % {days} AS INT)").alias("valid_from"),
            F.expr(f"IF(id % 11 = 0, NULL, DATE'2020-01-01' + CAST(id % {days} + pow(2, id % 10) + id % 7 AS INT))").alias("valid_to"),
        )
        write_levels(rows, f"{tmp_path}/{days}", USER)
        stored = read_levels(spark, f"{tmp_path}/{days}", rows.schema)
        for offset in (0, 1, days // 2, days - 1, 2 * days):
            day = dt.date(2020, 1, 1) + dt.timedelta(days=offset)
            got, expected = as_of_levels(stored, USER, day), as_of(rows, USER, day)
            assert got.exceptAll(expected).count() == expected.exceptAll(got).count() == 0
            got.collect()
            read.setdefault(days, []).append(partitions_read(got))
        stored_days[days] = stored.select("level", "cell").distinct().count()
    assert max(read[1024]) <= 3 * 11 + 1 < stored_days[1024] / 10
    assert max(read[1024]) < 2 * max(read[64])


def partitions_read(frame) -> int:
    scan = frame._jdf.queryExecution().executedPlan().collectLeaves().head()
    return scan.metrics().apply("numPartitions").value()


def test_one_key_of_a_day_is_looked_up_in_few_row_groups(spark, tmp_path):
    """Files are sorted by key and have a Bloom filter on it, so a key is looked up without reading the day."""
    rows = spark.range(400_000).select((F.col("id") * 2).alias("entity"), F.lit(dt.date(2024, 1, 1)).alias("day"), F.rand(1).alias("x"))
    settings = {"parquet.block.size": "200000", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64MB"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        write_days(rows, f"{tmp_path}/t", "day", key="entity")
    finally:
        for key in settings:
            spark.conf.unset(key)
    files = list(Path(f"{tmp_path}/t/day=2024-01-01").glob("*.parquet"))
    groups = [pq.ParquetFile(f).metadata.row_group(i) for f in files for i in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert len(groups) > 4
    spans = [(g.column(0).statistics.min, g.column(0).statistics.max) for g in groups]
    assert sum(a <= 4242 <= b for a, b in spans) <= len(files)
    found = read_table(spark, f"{tmp_path}/t", rows.schema, "day")
    for key, n in ((4242, 1), (4243, 0)):
        one = found.where(F.col("entity") == key)
        assert len(one.collect()) == n
        assert rows_read(one) <= (max(g.num_rows for g in groups) * len(files) if n else 0)


def rows_read(frame) -> int:
    scan = frame._jdf.queryExecution().executedPlan().collectLeaves().head()
    return scan.metrics().apply("numOutputRows").value()


def test_a_split_log_is_read_once(spark, tmp_path):
    log = change_log(spark, SF_DIR)
    assert nodes(plan(log), "FileScan") == 1
    counted = split_feeds(log, f"{tmp_path}/feeds", USER)
    stacked = all_feeds(spark, f"{tmp_path}/feeds", USER)
    assert nodes(plan(stacked), "FileScan") == 1
    assert counted == {r.source: r["count"] for r in log.groupBy("source").count().collect()}
    apart = union_sources({s.name: one_feed(spark, f"{tmp_path}/feeds", USER, s) for s in USER.sources}, USER)
    assert stacked.exceptAll(apart).count() == apart.exceptAll(stacked).count() == 0
    assert stacked.exceptAll(log).count() == log.exceptAll(stacked).count() == 0
    clicks = one_feed(spark, f"{tmp_path}/feeds", USER, USER.sources[1])
    clicks.collect()
    assert partitions_read(clicks) == 1 and clicks.columns == ["event_time", "event_day", "entity", "clicks"]


def test_a_row_of_an_unknown_feed_is_an_error(spark, tmp_path):
    log = change_log(spark, SF_DIR)
    for name in ("surprise", None):
        with pytest.raises(Exception, match="unknown feed"):
            split_feeds(log.withColumn("source", F.lit(name).cast("string")), f"{tmp_path}/feeds", USER)
    assert split_feeds(log.limit(0), f"{tmp_path}/empty", USER) == {s.name: 0 for s in USER.sources}
    assert all_feeds(spark, f"{tmp_path}/empty", USER).collect() == []


def test_frozen_past_cuts_the_scan_and_compares_digests(spark, tmp_path):
    split_feeds(change_log(spark, SF_DIR), f"{tmp_path}/feeds", USER)
    then = plan(known_by(all_feeds(spark, f"{tmp_path}/feeds", USER), USER, dt.date(2024, 1, 15)), "formatted")
    assert "PushedFilters: [Or(LessThan(event_time,2024-01-16" in then
    # A sound past is told by its digests; no version is compared.
    assert nodes(plan(QUERIES["check_past_frozen"](spark, SF_DIR)), "FileScan") == 0


def test_revenue_as_of_a_day_leaves_later_events_in_the_scan(spark):
    text = plan(QUERIES["gmv_daily_asof"](spark, SF_DIR), "formatted")
    assert "LessThan(ts,2024-01-16" in text
