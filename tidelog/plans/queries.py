"""Every operator as a named query over the given tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.checks import check_intervals, check_one_current
from tidelog.operators.counts import source_day_counts, stage_counts
from tidelog.operators.history import as_of
from tidelog.operators.rankings import REVENUE, top_producers, top_products
from tidelog.operators.revenue import REVENUE as GMV_VALUE
from tidelog.operators.revenue import gmv_as_of, gmv_current, gmv_null_group
from tidelog.operators.state import (
    block_forward_fill,
    collapse_days,
    daily_state,
    daily_state_of_events,
    with_day_sources,
)
from tidelog.operators.timeline import (
    drop_resent,
    latest_per_source_day,
    union_sources,
    with_fingerprint,
)
from tidelog.plans.history import check_past_frozen, history_of
from tidelog.plans.layers import Layers, build_daily, build_history, run_layers, stored_layer
from tidelog.plans.levels import as_of_levels, read_levels, write_levels
from tidelog.plans.publish import publish, read_published
from tidelog.plans.refresh import refresh_layers
from tidelog.plans.sql import (
    gmv_as_of_sql,
    gmv_current_sql,
    gmv_null_group_sql,
    register,
    top_producers_sql,
    top_products_sql,
)
from tidelog.plans.tables import (
    FEEDS,
    USER,
    USER_GMV,
    change_feeds,
    change_log,
    feed_tables,
    lines_as_items,
    lines_as_purchases,
    orders_as_purchases,
)
from tidelog.session import shared_folder
from tidelog.sources.events import MALFORMED, REASON, typed_events, with_event_day
from tidelog.sources.feeds import all_feeds
from tidelog.sources.tables import DAYS, read_table, start_together, write_days

AS_OF = dt.date(2024, 1, 15)
REFRESHED = dt.date(2024, 1, 15)
EMPTIED = dt.date(1900, 1, 1)
RANKED_YEAR = 1997
SILENT = "signup"
ONE_KEY = 7
UNDATED_EACH = 5
BUCKETS = 4
FULFILLED = "F"
MONEY = "decimal(28,2)"


def _flat(rows: DataFrame) -> DataFrame:
    """Sources of the day as text, the form both engines print alike."""
    return rows.withColumn(USER.day_sources, F.array_join(USER.day_sources, ","))


def _money(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn(column, F.col(column).cast(MONEY))


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_fingerprint(change_log(spark, sf_dir), USER)


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_per_source_day(_hashed(spark, sf_dir), USER)


def _history(spark: SparkSession, sf_dir: str, until: dt.date | None = None) -> DataFrame:
    return history_of(change_log(spark, sf_dir, until), USER)


def _deliver_raw(spark: SparkSession, sf_dir: str, folder: str, silent: str | None = None) -> None:
    """Drop the feeds as CSV with a header, one folder each, as their origin would; a ``silent`` feed has no rows."""

    def drop(name: str, feed: DataFrame) -> None:
        (feed if name != silent else feed.limit(0)).write.option("header", True).csv(f"{folder}/{name}")

    start_together(drop, change_feeds(spark, sf_dir))


def csv_typed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = shared_folder(spark, "csv_typed_scan")
    _deliver_raw(spark, sf_dir, raw)
    feeds = typed_events(spark, raw, USER)
    return union_sources({name: feed.drop(MALFORMED, REASON) for name, feed in feeds.items()}, USER)


def cdc_typed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events with their day derived anew over a wrong delivered one."""
    delivered = change_log(spark, sf_dir).withColumn(USER.event_day, F.lit("1900-01-01"))
    return with_event_day(delivered, USER)


def source_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_day_counts(change_log(spark, sf_dir), USER)


def cdc_union_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_sources(change_feeds(spark, sf_dir), USER)


def unified_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feeds of a split log, stacked by one scan."""
    stacked = all_feeds(spark, feed_tables(spark, sf_dir), USER)
    return latest_per_source_day(with_fingerprint(stacked, USER), USER)


def dedup_resent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_fingerprint(drop_resent(change_log(spark, sf_dir)), USER)


def forward_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_forward_fill(_timeline(spark, sf_dir), USER)


def daily_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = with_day_sources(_timeline(spark, sf_dir), USER)
    return _flat(tagged.select(USER.key, USER.event_day, USER.source_tag, USER.day_sources))


def daily_from_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(daily_state(_timeline(spark, sf_dir), USER))


def daily_step_by_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last filled event of a day, with the sources of the day."""
    return _flat(collapse_days(forward_filled(spark, sf_dir), USER))


def daily_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(daily_state_of_events(_hashed(spark, sf_dir), USER))


def scd2_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_history(spark, sf_dir))


def gmv_daily_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = register(_history(spark, sf_dir), "user_history")
    return _money(gmv_current_sql(spark, view, USER, USER_GMV), GMV_VALUE)


def gmv_daily_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later events cannot change what was known on a day, so the scan leaves them out."""
    view = register(_history(spark, sf_dir, AS_OF), "user_history")
    return _money(gmv_as_of_sql(spark, view, USER, USER_GMV, AS_OF), GMV_VALUE)


def gmv_daily_null_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money(gmv_null_group(_history(spark, sf_dir), USER, USER_GMV), GMV_VALUE)


def gmv_daily_null_group_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = register(_history(spark, sf_dir), "user_history")
    return _money(gmv_null_group_sql(spark, view, USER, USER_GMV), GMV_VALUE)


def _stored_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history as a table by day, read back."""
    path, history = shared_folder(spark, USER.history_table), _history(spark, sf_dir)
    write_days(history, path, USER.event_day, key=USER.key)
    return read_table(spark, path, history.schema, USER.event_day)


def gmv_current_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money(gmv_current(_stored_history(spark, sf_dir), USER, USER_GMV), GMV_VALUE)


def gmv_asof_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads only the days up to the one asked for."""
    return _money(gmv_as_of(_stored_history(spark, sf_dir), USER, USER_GMV, AS_OF), GMV_VALUE)


def gmv_asof_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads three cells at each level of interval length."""
    path, history = shared_folder(spark, "history_levels"), _history(spark, sf_dir)
    write_levels(history, path, USER)
    in_force = as_of_levels(read_levels(spark, path, history.schema), USER, AS_OF)
    return _money(gmv_as_of(in_force, USER, USER_GMV, AS_OF), GMV_VALUE)


def state_of_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known of one user on a day, looked up in the stored history."""
    return _flat(as_of(_stored_history(spark, sf_dir).where(F.col(USER.key) == ONE_KEY), USER, AS_OF))


def _built(spark: SparkSession, base: str, log: DataFrame) -> Layers:
    """Timeline, daily states and history of a log, stored."""
    layers = Layers(base, USER)
    timeline = latest_per_source_day(with_fingerprint(log, USER), USER)
    write_days(timeline, layers.timeline, USER.event_day)
    build_daily(spark, layers)
    build_history(spark, layers)
    return layers


def late_events_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored history of all but the purchases of one day, which then come late."""
    log = change_log(spark, sf_dir)
    late = (F.col(USER.source_tag) == "purchase") & (F.col(USER.event_day) == F.lit(REFRESHED))
    layers = _built(spark, shared_folder(spark, "late_events"), log.where(~F.coalesce(late, F.lit(False))))
    refresh_layers(spark, layers, log.where(late))
    return _flat(stored_layer(spark, layers, USER.history_table, layers.history))


def history_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, history = shared_folder(spark, "published"), _history(spark, sf_dir)
    publish(history, path, USER)
    return _flat(read_published(spark, path, history.schema, USER))


def chain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after each stage and days of each feed, as the chain observed them while it wrote."""
    base = shared_folder(spark, "chain_counts")
    _deliver_raw(spark, sf_dir, Layers(base, USER).raw)
    run = run_layers(spark, base, USER)
    counted = [(stage, n) for stage, n in run.stage_counts(USER).items()]
    counted += [(f"days of {name}", run.counts[f"bronze/{name}"][DAYS]) for name in FEEDS]
    return spark.createDataFrame(counted, "stage STRING, n BIGINT")


def counts_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_counts(_hashed(spark, sf_dir), USER)


def top50_producers_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = register(lines_as_purchases(spark, sf_dir), "line_purchases")
    return _money(top_producers_sql(spark, view, RANKED_YEAR, 50, FULFILLED), REVENUE)


def top50_producers_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    purchases = orders_as_purchases(spark, sf_dir)
    return _money(top_producers(purchases, RANKED_YEAR, 50, FULFILLED), REVENUE)


def top2_products_per_producer(spark: SparkSession, sf_dir: str) -> DataFrame:
    purchases = orders_as_purchases(spark, sf_dir)
    return _money(top_products(purchases, lines_as_items(spark, sf_dir), 2, FULFILLED), REVENUE)


def top2_products_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    purchases = register(orders_as_purchases(spark, sf_dir), "order_purchases")
    items = register(lines_as_items(spark, sf_dir), "line_items")
    return _money(top_products_sql(spark, purchases, items, 2, FULFILLED), REVENUE)


def layer_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw files through every layer, then the stored history."""
    base = shared_folder(spark, "layer_roundtrip")
    _deliver_raw(spark, sf_dir, Layers(base, USER).raw)
    return _flat(run_layers(spark, base, USER).history)


def layer_roundtrip_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the key shuffled once and all layers after that in buckets of it."""
    base = shared_folder(spark, "layer_roundtrip_buckets")
    _deliver_raw(spark, sf_dir, Layers(base, USER).raw)
    return _flat(run_layers(spark, base, USER, buckets=BUCKETS).history)


def layer_roundtrip_missing_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same before one feed has delivered anything: its file has a header only."""
    base = shared_folder(spark, "layer_roundtrip_missing_feed")
    _deliver_raw(spark, sf_dir, Layers(base, USER).raw, silent=SILENT)
    return _flat(run_layers(spark, base, USER).history)


def partition_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store a history with one day gone wrong and one that should be empty, then replace these two from a
    second stored table."""
    base = shared_folder(spark, "partition_refresh")
    path, source, day = f"{base}/{USER.history_table}", f"{base}/fresh", USER.event_day
    history = _history(spark, sf_dir)
    write_days(history, source, day)
    stored = read_table(spark, source, history.schema, day)
    that_day = F.col(day) == F.lit(REFRESHED)
    wrong = stored.withColumn("amount", F.when(~that_day, F.col("amount")))
    stray = stored.filter(that_day).withColumn(day, F.lit(EMPTIED))
    write_days(wrong.unionByName(stray), path, day)
    write_days(stored.filter(that_day), path, day, only_days=[REFRESHED, EMPTIED])
    return _flat(read_table(spark, path, history.schema, day))


def history_on_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(as_of(_history(spark, sf_dir), USER, AS_OF))


def one_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_one_current(_history(spark, sf_dir), USER)


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_intervals(_history(spark, sf_dir), USER)


def past_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_past_frozen(change_log(spark, sf_dir), USER, AS_OF, then=_history(spark, sf_dir, AS_OF))


def _partly_undated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with the times of some sign-ups lost."""
    lost = (F.col(USER.source_tag) == "signup") & (F.col("signup_code") % UNDATED_EACH == 0)
    return change_log(spark, sf_dir).withColumns(
        {c: F.when(~F.coalesce(lost, F.lit(False)), F.col(c)) for c in (USER.event_time, USER.event_day)}
    )


def past_frozen_undated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_past_frozen(_partly_undated(spark, sf_dir), USER, AS_OF)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv_typed_scan": csv_typed_scan,
    "cdc_typed_events": cdc_typed_events,
    "source_day_counts": source_days,
    "cdc_union_timeline": cdc_union_timeline,
    "event_fingerprint": _hashed,
    "dedup_resent_events": dedup_resent_events,
    "latest_per_source_day": _timeline,
    "unified_timeline": unified_feeds,
    "block_forward_fill": forward_filled,
    "daily_sources": daily_sources,
    "daily_state": daily_from_timeline,
    "daily_state_of_events": daily_from_events,
    "daily_state_step_by_step": daily_step_by_step,
    "scd2_history": scd2_history,
    "history_as_of": history_on_day,
    "gmv_daily_current": gmv_daily_current,
    "gmv_daily_asof": gmv_daily_asof,
    "gmv_daily_null_group": gmv_daily_null_group,
    "gmv_daily_null_group_sql": gmv_daily_null_group_sql,
    "gmv_current_stored": gmv_current_stored,
    "gmv_asof_stored": gmv_asof_stored,
    "stage_counts": counts_by_stage,
    "top50_producers_year": top50_producers_year,
    "top50_producers_by_order": top50_producers_by_order,
    "top2_products_per_producer": top2_products_per_producer,
    "top2_products_in_sql": top2_products_in_sql,
    "layer_roundtrip": layer_roundtrip,
    "layer_roundtrip_missing_feed": layer_roundtrip_missing_feed,
    "layer_roundtrip_buckets": layer_roundtrip_buckets,
    "partition_refresh": partition_refresh,
    "check_one_current": one_current,
    "check_intervals": intervals,
    "check_past_frozen": past_frozen,
    "check_past_frozen_undated": past_frozen_undated,
    "gmv_asof_levels": gmv_asof_levels,
    "state_of_one_key": state_of_one_key,
    "late_events_repaired": late_events_repaired,
    "history_published": history_published,
    "chain_counts": chain_counts,
}
