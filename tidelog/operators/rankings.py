"""Revenue rankings over purchases and product items. Ties go to the lower id."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Result columns and the status that counts.
YEAR, REVENUE, RANK = "year_of_purchase", "faturamento", "rank"
APPROVED = "APROVADA"

ITEM_KEY = ["prod_item_id", "prod_item_partition"]


def top_producers(
    purchases: DataFrame, year: int, n: int = 50, status: str = APPROVED
) -> DataFrame:
    """The ``n`` producers with the highest order total in ``year``.

    The year is a half-open range, right for dates and timestamps alike and usable by the scan.
    """
    ordered = F.col("order_date")
    in_year = (ordered >= F.lit(dt.date(year, 1, 1))) & (ordered < F.lit(dt.date(year + 1, 1, 1)))
    return (
        purchases.filter(in_year & (F.col("purchase_status") == status))
        .groupBy(F.year(ordered).alias(YEAR), "producer_id")
        .agg(F.round(F.sum("purchase_total_value"), 2).alias(REVENUE))
        .orderBy(F.desc(REVENUE), "producer_id")
        .limit(n)
    )


def top_products(
    purchases: DataFrame, items: DataFrame, n: int = 2, status: str = APPROVED
) -> DataFrame:
    """The ``n`` products with the highest item value for each producer.

    Both sides are summed before the join: purchases to a count per item and producer, items to a value per item
    and product. The join then yields a row per item, producer and product and no more, however often an
    item is bought or listed.
    """
    bought = (
        purchases.filter(F.col("purchase_status") == status)
        .groupBy(*ITEM_KEY, "producer_id")
        .agg(F.count(F.lit(1)).alias("_times"))
    )
    worth = items.groupBy(*ITEM_KEY, "product_id").agg(F.sum("purchase_value").alias("_value"))
    revenue = (
        bought.join(worth, ITEM_KEY)
        .groupBy("producer_id", "product_id")
        .agg(F.round(F.sum(F.col("_value") * F.col("_times")), 2).alias(REVENUE))
    )
    best = Window.partitionBy("producer_id").orderBy(F.desc(REVENUE), "product_id")
    return (
        revenue.withColumn(RANK, F.row_number().over(best))
        .filter(F.col(RANK) <= n)
        .orderBy("producer_id", RANK)
    )
