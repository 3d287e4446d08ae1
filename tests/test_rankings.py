from __future__ import annotations

import golden
import pytest

from tidelog.operators.rankings import APPROVED, top_producers, top_products
from tidelog.plans.sql import register, top_producers_sql, top_products_sql

PURCHASE_TYPES = {
    "purchase_id": "BIGINT",
    "producer_id": "BIGINT",
    "prod_item_id": "BIGINT",
    "prod_item_partition": "BIGINT",
    "order_date": "DATE",
    "purchase_total_value": "DECIMAL(18,2)",
    "purchase_status": "STRING",
}
ITEM_TYPES = {
    "prod_item_id": "BIGINT",
    "prod_item_partition": "BIGINT",
    "product_id": "BIGINT",
    "item_quantity": "INT",
    "purchase_value": "DECIMAL(18,2)",
}


def _load(spark, phrase, types):
    rows = [tuple(row.values()) for row in golden.table(phrase)]
    texts = spark.createDataFrame(rows, ", ".join(f"{name} STRING" for name in types))
    return texts.select(*[texts[name].cast(kind).alias(name) for name, kind in types.items()])


@pytest.fixture(scope="module")
def purchases(spark):
    return _load(spark, "`df_purchase`", PURCHASE_TYPES)


@pytest.fixture(scope="module")
def items(spark):
    return _load(spark, "`df_product_item`", ITEM_TYPES)


def test_top_producers_of_a_year(spark, purchases):
    expected = [tuple(row.values()) for row in golden.table("Top producers of 2021")]
    view = register(purchases, "df_purchase")
    columns = ["year_of_purchase", "producer_id", "faturamento"]
    for result in (
        top_producers(purchases, 2021),
        top_producers_sql(spark, view, 2021, 50, APPROVED),
    ):
        assert golden.printed(result.collect(), columns) == expected


def test_limit_and_last_moment_of_the_year(purchases):
    stamped = purchases.selectExpr(
        "* EXCEPT (order_date)",
        "CAST(order_date AS TIMESTAMP_NTZ) + INTERVAL '23:59' HOUR TO MINUTE AS order_date",
    )
    rows = top_producers(stamped, 2021, n=2).collect()
    assert [row.producer_id for row in rows] == [10, 20]
    assert str(rows[0].faturamento) == "95.50"


def test_top_products_join_on_both_keys(spark, purchases, items):
    expected = [tuple(row.values()) for row in golden.table("Top-2 products per producer")]
    columns = ["producer_id", "product_id", "faturamento", "rank"]
    views = register(purchases, "df_purchase"), register(items, "df_product_item")
    for result in (top_products(purchases, items), top_products_sql(spark, *views, 2, APPROVED)):
        assert golden.printed(result.collect(), columns) == expected


def test_counting_purchases_first_equals_summing_all_pairs(spark, purchases, items):
    """Items bought many times, items with several rows, and values that are NULL."""
    many = purchases.withColumn("prod_item_id", purchases.prod_item_id % 3)
    many = many.unionByName(many).unionByName(purchases)
    valued = items.selectExpr(
        "prod_item_id % 3 AS prod_item_id", "prod_item_partition", "product_id",
        "nullif(purchase_value, 10.00) AS purchase_value",
    ).unionByName(items.drop("item_quantity"))
    register(many, "many_purchases")
    register(valued, "valued_items")
    pairs = spark.sql(
        """SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY producer_id
                                       ORDER BY faturamento DESC, product_id) AS rank
          FROM (SELECT producer_id, product_id, round(sum(purchase_value), 2) AS faturamento
                FROM many_purchases JOIN valued_items USING (prod_item_id, prod_item_partition)
                WHERE purchase_status = 'APROVADA' GROUP BY ALL))
        WHERE rank <= 2 ORDER BY producer_id, rank"""
    ).collect()
    got = top_products(many, valued).collect()
    columns = ["producer_id", "product_id", "faturamento", "rank"]
    assert golden.printed(got, columns) == golden.printed(pairs, columns)
