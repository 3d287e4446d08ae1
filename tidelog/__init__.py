"""Histories and revenue from change logs, as plain Spark DataFrame work."""

from tidelog.config import GMV, PURCHASE, EntitySpec, MetricSpec, SourceSpec
from tidelog.operators.history import as_of, scd2
from tidelog.operators.rankings import top_producers, top_products
from tidelog.operators.revenue import gmv_as_of, gmv_current, gmv_null_group
from tidelog.operators.state import block_forward_fill, daily_state, daily_state_of_events
from tidelog.operators.timeline import unify
from tidelog.plans.history import history_of
from tidelog.plans.layers import Layers, run_layers
from tidelog.session import get_spark

__all__ = [
    "GMV",
    "PURCHASE",
    "EntitySpec",
    "Layers",
    "MetricSpec",
    "SourceSpec",
    "as_of",
    "block_forward_fill",
    "daily_state",
    "daily_state_of_events",
    "get_spark",
    "gmv_as_of",
    "gmv_current",
    "gmv_null_group",
    "history_of",
    "run_layers",
    "scd2",
    "top_producers",
    "top_products",
    "unify",
]
