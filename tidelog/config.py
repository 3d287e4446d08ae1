"""What the library is told about the data: feeds, who owns which column, column and table names.

Nothing in the operators is tied to one business entity; every function takes one of these specs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


# Spark's names of types, in any case: those of text, and those whose values have no one text.
_TEXT = re.compile(r"\s*(string|varchar|char|character)\b", re.I)
_INEXACT = re.compile(r"\s*(double|float|real)\b", re.I)


@dataclass(frozen=True)
class SourceSpec:
    """One change feed: its delivered columns (name to SQL type) and those only it may write."""

    name: str
    schema: dict[str, str]
    owned: tuple[str, ...]

    @property
    def ddl(self) -> str:
        return ", ".join(f"`{column}` {kind}" for column, kind in self.schema.items())

    @property
    def text_columns(self) -> list[str]:
        """Owned columns of string type, the only ones whose text can contain a separator."""
        return [c for c in self.owned if _TEXT.match(self.schema[c])]


@dataclass(frozen=True)
class EntitySpec:
    """An entity described by several feeds, and the names used for what the library derives."""

    key: str
    event_time: str
    event_day: str
    source_tag: str
    fingerprint: str
    day_sources: str
    valid_from: str
    valid_to: str
    is_current: str
    timeline_table: str
    daily_table: str
    history_table: str
    sources: tuple[SourceSpec, ...]

    def __post_init__(self) -> None:
        seen: dict[str, str] = {}
        for source in self.sources:
            for column in source.owned:
                if column not in source.schema:
                    raise ValueError(f"{source.name} owns {column!r} but does not deliver it")
                if _INEXACT.match(source.schema[column]):
                    raise ValueError(f"{column!r} is a floating-point number, whose text is not stable")
                if column in seen:
                    raise ValueError(f"{column!r} is owned by {seen[column]} and {source.name}")
                seen[column] = source.name
            for column in (self.key, self.event_time):
                if column not in source.schema:
                    raise ValueError(f"{source.name} does not deliver {column!r}")

    @property
    def key_columns(self) -> list[str]:
        return [self.event_time, self.event_day, self.key, self.source_tag]

    @property
    def owned_columns(self) -> list[str]:
        return [column for source in self.sources for column in source.owned]

    @property
    def columns(self) -> list[str]:
        """Canonical column order of a timeline row: keys, then one block per feed."""
        return self.key_columns + self.owned_columns

    @property
    def text_columns(self) -> list[str]:
        return [column for source in self.sources for column in source.text_columns]


@dataclass(frozen=True)
class MetricSpec:
    """Daily revenue per segment: when it counts, for whom, and how much."""

    paid_day: str
    segment: str
    amount: str
    missing_segment: str


# Names, types and labels of the purchase data model, which stored layers and existing
# SQL depend on.
PURCHASE = EntitySpec(
    key="purchase_id",
    event_time="transaction_datetime",
    event_day="transaction_date",
    source_tag="origem_evento",
    fingerprint="hash_evento",
    day_sources="fontes_no_dia",
    valid_from="dt_inicio_validade",
    valid_to="dt_fim_validade",
    is_current="is_current",
    timeline_table="eventos_unificados",
    daily_table="purchase_diario",
    history_table="purchase_historico",
    sources=(
        SourceSpec(
            "purchase",
            {
                "transaction_datetime": "TIMESTAMP_NTZ",
                "transaction_date": "STRING",
                "purchase_id": "BIGINT",
                "buyer_id": "BIGINT",
                "prod_item_id": "BIGINT",
                "order_date": "DATE",
                "release_date": "DATE",
                "producer_id": "BIGINT",
            },
            ("buyer_id", "prod_item_id", "order_date", "release_date", "producer_id"),
        ),
        SourceSpec(
            "product_item",
            {
                "transaction_datetime": "TIMESTAMP_NTZ",
                "transaction_date": "STRING",
                "purchase_id": "BIGINT",
                "product_id": "BIGINT",
                "item_quantity": "INT",
                "purchase_value": "DECIMAL(18,2)",
            },
            ("product_id", "item_quantity", "purchase_value"),
        ),
        SourceSpec(
            "purchase_extra_info",
            {
                "transaction_datetime": "TIMESTAMP_NTZ",
                "transaction_date": "STRING",
                "purchase_id": "BIGINT",
                "subsidiary": "STRING",
            },
            ("subsidiary",),
        ),
    ),
)
GMV = MetricSpec(
    paid_day="release_date",
    segment="subsidiary",
    amount="purchase_value",
    missing_segment="não informada",
)
