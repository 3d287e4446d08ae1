"""The same queries in plain SQL, built step by step as common table expressions.

Deliberately the long way round: events are deduplicated, ranked, filled per event and collapsed
with windows, none of which the Spark plans for the history do.
"""

from __future__ import annotations

from tidelog.functions.fingerprint import NULL_TEXT, SEPARATOR
from tidelog.plans.queries import AS_OF, FULFILLED, ONE_KEY, RANKED_YEAR, SILENT, UNDATED_EACH
from tidelog.plans.tables import USER, USER_GMV

_OWNED = ", ".join(USER.owned_columns)
_KEYS = "event_time, event_day, entity, source"
_DAILY = f"event_time, event_day, entity, {_OWNED}"
_VERSION = f"{_DAILY}, day_sources, valid_from"
_CONTENT = ", ".join(
    f"coalesce(CAST({column} AS VARCHAR), '{NULL_TEXT}')" for column in sorted(USER.columns)
)


def _events(where: str = "TRUE", time: str = "ts") -> str:
    return f"""
delivered AS (
    SELECT date_trunc('hour', {time}) AS event_time,
           CAST({time} AS DATE) AS event_day,
           user_id AS entity,
           event_type AS source,
           CAST(value AS DECIMAL(18,2)) AS money,
           CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
    FROM events
    WHERE {where}
),
log AS (
    SELECT {_KEYS},
           CASE WHEN source = 'purchase' THEN money END AS amount,
           CASE WHEN source = 'purchase' AND k >= 10 THEN event_day END AS paid_date,
           CASE WHEN source = 'click' THEN k END AS clicks,
           CASE WHEN source = 'error' AND k >= 5 THEN concat('seg', k % 4) END AS segment,
           CASE WHEN source = 'signup' THEN k END AS signup_code,
           CASE WHEN source = 'view' THEN k END AS view_code,
           CASE WHEN source = 'view' THEN money END AS view_value
    FROM (SELECT * FROM delivered
          UNION ALL
          SELECT * FROM delivered WHERE source = 'purchase')
),
hashed AS (
    SELECT *, sha256(concat_ws('{SEPARATOR}', {_CONTENT})) AS event_hash FROM log
),
deduplicated AS (SELECT DISTINCT * FROM hashed),
latest AS (
    SELECT * FROM deduplicated
    QUALIFY row_number() OVER (PARTITION BY entity, source, event_day
                               ORDER BY event_time DESC NULLS LAST, event_hash DESC) = 1
)"""


def _carried(source: str, columns: tuple[str, ...]) -> str:
    fields = ", ".join(f"{column} := {column}" for column in columns)
    return f"""last_value(CASE WHEN source = '{source}' THEN struct_pack({fields}) END IGNORE NULLS)
               OVER so_far AS b_{source}"""


_BLOCKS = ",\n           ".join(_carried(s.name, s.owned) for s in USER.sources)
_FROM_BLOCKS = ", ".join(f"b_{s.name}.{c} AS {c}" for s in USER.sources for c in s.owned)

_STATES = f"""
filled AS (
    SELECT {_KEYS}, {_FROM_BLOCKS}, event_hash
    FROM (SELECT {_KEYS}, event_hash,
           {_BLOCKS}
          FROM latest
          WINDOW so_far AS (PARTITION BY entity ORDER BY event_time NULLS FIRST, event_hash
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
),
spoken AS (
    SELECT entity, event_day, string_agg(DISTINCT source, ',' ORDER BY source) AS day_sources
    FROM latest GROUP BY entity, event_day
),
daily AS (
    SELECT filled.*EXCLUDE (source), day_sources
    FROM filled JOIN spoken ON spoken.entity = filled.entity AND spoken.event_day IS NOT DISTINCT FROM filled.event_day
    QUALIFY row_number() OVER (PARTITION BY filled.entity, filled.event_day
                               ORDER BY event_time DESC NULLS LAST, event_hash DESC) = 1
),
ended AS (
    SELECT *, event_day AS valid_from,
           CAST(lead(event_day) OVER (PARTITION BY entity ORDER BY event_day NULLS FIRST)
                - INTERVAL 1 DAY AS DATE) AS valid_to
    FROM daily
),
history AS (SELECT {_VERSION}, valid_to, valid_to IS NULL AS is_current FROM ended)"""


def _on_log(query: str) -> str:
    return f"WITH {_events()}\n{query}"


def _on_history(query: str, where: str = "TRUE") -> str:
    return f"WITH {_events(where)},{_STATES}\n{query}"


_IN_FORCE = f"DATE '{AS_OF}' BETWEEN valid_from AND coalesce(valid_to, DATE '9999-12-31')"


def _gmv(in_force: str, segment: str) -> str:
    return _on_history(
        f"""SELECT paid_date AS dia, {segment} AS subsidiaria,
       CAST(sum(amount) AS DECIMAL(28,2)) AS gmv
FROM history WHERE paid_date IS NOT NULL AND {in_force}
GROUP BY paid_date, {segment}"""
    )


_NAMED = f"coalesce(segment, '{USER_GMV.missing_segment}')"
_HISTORY = _on_history("SELECT * FROM history")


_UNDATED = f"""CASE WHEN event_type <> 'signup'
                OR coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT) % {UNDATED_EACH}, 1) <> 0 THEN ts END"""


def _past_frozen(time: str = "ts") -> str:
    """Both histories as subqueries with their own steps, then their differences each way. Events without a time are
    known from the beginning."""

    def versions(events: str, where: str) -> str:
        return f"(WITH {events},{_STATES} SELECT {_VERSION} FROM history WHERE {where})"

    then = versions(_events(f"coalesce(CAST({time} AS DATE) <= DATE '{AS_OF}', TRUE)", time), "TRUE")
    now = versions(_events(time=time), f"coalesce(valid_from <= DATE '{AS_OF}', TRUE)")
    return f"""SELECT CAST((SELECT count(*) FROM (SELECT * FROM {then} EXCEPT ALL SELECT * FROM {now}))
          + (SELECT count(*) FROM (SELECT * FROM {now} EXCEPT ALL SELECT * FROM {then}))
       AS BIGINT) AS violations"""


_TOP2_PRODUCTS = f"""
WITH revenue AS (
    SELECT o_custkey AS producer_id, l_partkey AS product_id,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS faturamento
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey
    WHERE o_orderstatus = '{FULFILLED}'
    GROUP BY 1, 2
)
SELECT producer_id, product_id, faturamento,
       CAST(row_number() OVER (PARTITION BY producer_id
                               ORDER BY faturamento DESC, product_id) AS INTEGER) AS rank
FROM revenue
QUALIFY rank <= 2"""


ORACLES: dict[str, str] = {
    "csv_typed_scan": _on_log("SELECT * FROM log"),
    "cdc_typed_events": _on_log("SELECT * FROM log"),
    "source_day_counts": _on_log(
        """SELECT source, count(*) AS events, count(DISTINCT event_day) AS days
FROM log GROUP BY source"""
    ),
    "cdc_union_timeline": _on_log("SELECT * FROM log"),
    "event_fingerprint": _on_log("SELECT * FROM hashed"),
    "dedup_resent_events": _on_log("SELECT * FROM deduplicated"),
    "latest_per_source_day": _on_log("SELECT * FROM latest"),
    "unified_timeline": _on_log("SELECT * FROM latest"),
    "block_forward_fill": _on_history("SELECT * FROM filled"),
    "daily_sources": _on_history(
        """SELECT entity, event_day, source, day_sources
FROM latest JOIN spoken USING (entity, event_day)"""
    ),
    "daily_state": _on_history("SELECT * FROM daily"),
    "daily_state_of_events": _on_history("SELECT * FROM daily"),
    "daily_state_step_by_step": _on_history("SELECT * FROM daily"),
    "scd2_history": _HISTORY,
    "history_as_of": _on_history(f"SELECT * FROM history WHERE {_IN_FORCE}"),
    "gmv_daily_current": _gmv("is_current", _NAMED),
    "gmv_daily_asof": _gmv(_IN_FORCE, _NAMED),
    "gmv_daily_null_group": _gmv("is_current", "segment"),
    "gmv_daily_null_group_sql": _gmv("is_current", "segment"),
    "gmv_current_stored": _gmv("is_current", _NAMED),
    "gmv_asof_stored": _gmv(_IN_FORCE, _NAMED),
    "stage_counts": _on_history(
        """SELECT (SELECT count(*) FROM log) AS stacked,
       (SELECT count(*) FROM deduplicated) AS deduplicated,
       (SELECT count(*) FROM latest) AS latest,
       (SELECT count(*) FROM daily) AS daily,
       (SELECT count(*) FROM history) AS versions,
       (SELECT count(*) FROM history WHERE is_current) AS current"""
    ),
    "top50_producers_year": f"""
SELECT CAST(year(o_orderdate) AS INTEGER) AS year_of_purchase, l_suppkey AS producer_id,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS faturamento
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE year(o_orderdate) = {RANKED_YEAR} AND o_orderstatus = '{FULFILLED}'
GROUP BY 1, 2
ORDER BY faturamento DESC, producer_id
LIMIT 50""",
    "top50_producers_by_order": f"""
SELECT CAST(year(o_orderdate) AS INTEGER) AS year_of_purchase, o_custkey AS producer_id,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS faturamento
FROM orders
WHERE year(o_orderdate) = {RANKED_YEAR} AND o_orderstatus = '{FULFILLED}'
GROUP BY 1, 2
ORDER BY faturamento DESC, producer_id
LIMIT 50""",
    "top2_products_per_producer": _TOP2_PRODUCTS,
    "top2_products_in_sql": _TOP2_PRODUCTS,
    "layer_roundtrip": _HISTORY,
    "layer_roundtrip_buckets": _HISTORY,
    "layer_roundtrip_missing_feed": _on_history("SELECT * FROM history", f"event_type <> '{SILENT}'"),
    "partition_refresh": _HISTORY,
    "check_one_current": _on_history(
        """SELECT count(*) AS violations
FROM (SELECT entity FROM history GROUP BY entity HAVING count(*) FILTER (is_current) <> 1)"""
    ),
    "check_intervals": _on_history(
        """SELECT count(*) AS violations
FROM (SELECT valid_to, lead(valid_from) OVER (PARTITION BY entity ORDER BY valid_from) AS following
      FROM history)
WHERE following IS NOT NULL AND following IS DISTINCT FROM valid_to + 1"""
    ),
    "check_past_frozen": _past_frozen(),
    "check_past_frozen_undated": _past_frozen(_UNDATED),
    "gmv_asof_levels": _gmv(_IN_FORCE, _NAMED),
    "state_of_one_key": _on_history(f"SELECT * FROM history WHERE entity = {ONE_KEY} AND {_IN_FORCE}"),
    "late_events_repaired": _HISTORY,
    "history_published": _HISTORY,
    "chain_counts": _on_history(
        """SELECT 'stacked' AS stage, count(*) AS n FROM log
UNION ALL SELECT 'deduplicated', count(*) FROM deduplicated
UNION ALL SELECT 'latest', count(*) FROM latest
UNION ALL SELECT 'daily', count(*) FROM daily
UNION ALL SELECT 'versions', count(*) FROM history
UNION ALL SELECT 'current', count(*) FROM history WHERE is_current
UNION ALL SELECT 'days of ' || source, count(DISTINCT event_day) FROM log GROUP BY source"""
    ),
}
