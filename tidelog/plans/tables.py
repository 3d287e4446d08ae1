"""The given tables seen as change feeds and as purchases.

``events`` is five feeds about a user, told apart by event type. Its times are cut to the hour, which
makes ties common, and the purchase feed is delivered twice, which gives re-sends.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.config import EntitySpec, MetricSpec, SourceSpec
from tidelog.session import shared_folder
from tidelog.sources.feeds import one_feed, split_feeds

_KEYS = {"event_time": "TIMESTAMP_NTZ", "event_day": "STRING", "entity": "BIGINT"}

USER = EntitySpec(
    key="entity",
    event_time="event_time",
    event_day="event_day",
    source_tag="source",
    fingerprint="event_hash",
    day_sources="day_sources",
    valid_from="valid_from",
    valid_to="valid_to",
    is_current="is_current",
    timeline_table="timeline",
    daily_table="daily_state",
    history_table="history",
    sources=(
        SourceSpec(
            "purchase",
            _KEYS | {"amount": "DECIMAL(18,2)", "paid_date": "DATE"},
            ("amount", "paid_date"),
        ),
        SourceSpec("click", _KEYS | {"clicks": "BIGINT"}, ("clicks",)),
        SourceSpec("error", _KEYS | {"segment": "STRING"}, ("segment",)),
        SourceSpec("signup", _KEYS | {"signup_code": "BIGINT"}, ("signup_code",)),
        SourceSpec(
            "view",
            _KEYS | {"view_code": "BIGINT", "view_value": "DECIMAL(18,2)"},
            ("view_code", "view_value"),
        ),
    ),
)
USER_GMV = MetricSpec(
    paid_day="paid_date", segment="segment", amount="amount", missing_segment="não informada"
)
FEEDS = [source.name for source in USER.sources]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _facts(spark: SparkSession, sf_dir: str, until: dt.date | None = None) -> DataFrame:
    """Events with the hour they fell in and the integer of their properties.

    The hour is found by subtraction: truncating would go through a zoned timestamp.
    """
    past_the_hour = F.make_dt_interval(
        F.lit(0), F.lit(0), F.minute("ts"), F.expr("extract(SECOND FROM ts)")
    )
    events = table(spark, sf_dir, "events")
    if until is not None:
        next_day = F.lit(dt.datetime.combine(until + dt.timedelta(days=1), dt.time())).cast(events.schema["ts"].dataType)
        events = events.filter((F.col("ts") < next_day) | F.col("ts").isNull())
    return events.select(
        F.col("user_id").alias("entity"),
        "event_type",
        (F.col("ts") - past_the_hour).alias("event_time"),
        F.to_date("ts").alias("event_day"),
        F.col("value").try_cast("decimal(18,2)").alias("money"),
        F.get_json_object("props", "$.k").try_cast("bigint").alias("k"),
    )


def _said() -> dict[str, dict[str, Column]]:
    """What each feed says, over the columns of ``_facts``; low ``k`` stands for "empty"."""
    k, money = F.col("k"), F.col("money")
    return {
        "purchase": {"amount": money, "paid_date": F.when(k >= 10, F.col("event_day"))},
        "click": {"clicks": k},
        "error": {"segment": F.when(k >= 5, F.concat(F.lit("seg"), k % 4))},
        "signup": {"signup_code": k},
        "view": {"view_code": k, "view_value": money},
    }


def _delivered(facts: DataFrame) -> DataFrame:
    """Repeat what is sent twice, within the scan."""
    times = F.when(F.col("event_type") == "purchase", 2).otherwise(1)
    return facts.withColumn("_delivery", F.explode(F.sequence(F.lit(1), times)))


def change_feeds(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """One frame per feed with only the columns that feed delivers, each from a table of its own. ``events`` is read once,
    to split it."""
    path = feed_tables(spark, sf_dir)
    return {source.name: one_feed(spark, path, USER, source) for source in USER.sources}


def feed_tables(spark: SparkSession, sf_dir: str) -> str:
    """Folder with a table for each feed."""
    path = shared_folder(spark, "feeds")
    split_feeds(change_log(spark, sf_dir), path, USER)
    return path


def change_log(spark: SparkSession, sf_dir: str, until: dt.date | None = None) -> DataFrame:
    """The stacked feeds in one scan: same rows as the union of :func:`change_feeds`.

    An event type that no feed has is an error. ``until`` leaves events after that day in the scan; undated ones stay.
    """
    tag = F.col("event_type")
    columns = [
        F.when(tag == name, value).alias(column)
        for name, said in _said().items()
        for column, value in said.items()
    ]
    unknown = F.raise_error(F.concat(F.lit("unknown event type: "), F.coalesce(tag, F.lit("NULL"))))
    known = F.when(tag.isin(FEEDS), tag).otherwise(unknown.cast("string"))
    return _delivered(_facts(spark, sf_dir, until)).select(
        "event_time", "event_day", "entity", known.alias(USER.source_tag), *columns
    )


def orders_as_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a purchase from the producer behind its customer number, of the item that bears
    its order key. Order keys are spread over eight item partitions, as a second join key."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("producer_id"),
        F.col("o_orderkey").alias("prod_item_id"),
        (F.col("o_orderkey") % 8).alias("prod_item_partition"),
        F.col("o_orderdate").alias("order_date"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("purchase_total_value"),
        F.col("o_orderstatus").alias("purchase_status"),
    )


def lines_as_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("prod_item_id"),
        (F.col("l_orderkey") % 8).alias("prod_item_partition"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("purchase_value"),
    )


def lines_as_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order line as a purchase from its supplier, dated and approved by its order."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_orderdate").alias("order_date"),
        F.col("o_orderstatus").alias("purchase_status"),
    )
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.col("l_suppkey").alias("producer_id"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("purchase_total_value"),
    )
    return lines.join(orders, "l_orderkey").drop("l_orderkey")
