"""The metrics and rankings as Spark SQL on registered views, for those who query in SQL.

Column names come in as identifiers and values as named parameters; no text is spliced.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from tidelog.config import EntitySpec, MetricSpec
from tidelog.operators.rankings import RANK, REVENUE, YEAR
from tidelog.operators.revenue import DAY, SEGMENT
from tidelog.operators.revenue import REVENUE as GMV

_GMV = f"""
SELECT IDENTIFIER(:paid_day) AS {DAY}, {{segment}} AS {SEGMENT}, sum(IDENTIFIER(:amount)) AS {GMV}
FROM IDENTIFIER(:history)
WHERE IDENTIFIER(:paid_day) IS NOT NULL
  AND {{in_force}}
GROUP BY 1, 2
ORDER BY 1, 2
"""

_NAMED_SEGMENT = "coalesce(IDENTIFIER(:segment), :missing)"

GMV_CURRENT = _GMV.format(segment=_NAMED_SEGMENT, in_force="IDENTIFIER(:is_current)")

GMV_NULL_GROUP = _GMV.format(segment="IDENTIFIER(:segment)", in_force="IDENTIFIER(:is_current)")

GMV_AS_OF = _GMV.format(
    segment=_NAMED_SEGMENT,
    in_force="""IDENTIFIER(:event_day) <= :day
  AND IDENTIFIER(:valid_from) <= :day
  AND (IDENTIFIER(:valid_to) IS NULL OR IDENTIFIER(:valid_to) >= :day)""",
)

TOP_PRODUCERS = f"""
SELECT year(order_date) AS {YEAR}, producer_id, round(sum(purchase_total_value), 2) AS {REVENUE}
FROM IDENTIFIER(:purchases)
WHERE order_date >= make_date(:year, 1, 1)
  AND order_date < make_date(:year + 1, 1, 1)
  AND purchase_status = :status
GROUP BY ALL
ORDER BY {REVENUE} DESC, producer_id
LIMIT :n
"""

# Purchases and items are summed before the join, as in the DataFrame form.
TOP_PRODUCTS = f"""
WITH bought AS (
    SELECT prod_item_id, prod_item_partition, producer_id, count(*) AS times
    FROM IDENTIFIER(:purchases)
    WHERE purchase_status = :status
    GROUP BY ALL
),
worth AS (
    SELECT prod_item_id, prod_item_partition, product_id, sum(purchase_value) AS value
    FROM IDENTIFIER(:items)
    GROUP BY ALL
),
revenue AS (
    SELECT producer_id, product_id, round(sum(value * times), 2) AS {REVENUE}
    FROM bought JOIN worth USING (prod_item_id, prod_item_partition)
    GROUP BY ALL
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY producer_id ORDER BY {REVENUE} DESC, product_id) AS {RANK}
    FROM revenue
)
SELECT * FROM ranked WHERE {RANK} <= :n ORDER BY producer_id, {RANK}
"""


def register(frame: DataFrame, view: str) -> str:
    frame.createOrReplaceTempView(view)
    return view


def _names(history: str, metric: MetricSpec) -> dict[str, str]:
    return {
        "history": history,
        "paid_day": metric.paid_day,
        "segment": metric.segment,
        "amount": metric.amount,
        "missing": metric.missing_segment,
    }


def gmv_current_sql(
    spark: SparkSession, history: str, spec: EntitySpec, metric: MetricSpec
) -> DataFrame:
    return spark.sql(GMV_CURRENT, {**_names(history, metric), "is_current": spec.is_current})


def gmv_null_group_sql(
    spark: SparkSession, history: str, spec: EntitySpec, metric: MetricSpec
) -> DataFrame:
    """Amounts without a segment stay a group of their own, named NULL."""
    return spark.sql(GMV_NULL_GROUP, {**_names(history, metric), "is_current": spec.is_current})


def gmv_as_of_sql(
    spark: SparkSession, history: str, spec: EntitySpec, metric: MetricSpec, day: dt.date
) -> DataFrame:
    interval = {
        "event_day": spec.event_day,
        "valid_from": spec.valid_from,
        "valid_to": spec.valid_to,
        "day": day,
    }
    return spark.sql(GMV_AS_OF, {**_names(history, metric), **interval})


def top_producers_sql(
    spark: SparkSession, purchases: str, year: int, n: int, status: str
) -> DataFrame:
    return spark.sql(
        TOP_PRODUCERS, {"purchases": purchases, "year": year, "n": n, "status": status}
    )


def top_products_sql(
    spark: SparkSession, purchases: str, items: str, n: int, status: str
) -> DataFrame:
    return spark.sql(
        TOP_PRODUCTS, {"purchases": purchases, "items": items, "n": n, "status": status}
    )
