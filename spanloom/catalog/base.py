"""The registry, and the testbed's projections in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

CALLS = """calls AS (SELECT CAST(event_id AS VARCHAR) AS span_id, CAST(user_id AS VARCHAR) AS run_id, 'flow-' || (user_id % 3) AS workflow, CAST(k % 8 AS VARCHAR) AS step,
 ['lab/alpha-7b', 'Beta:large', 'alpha-judge'][k % 3 + 1] AS model, CASE WHEN k % 3 = 2 THEN 's' || (k % 4) END AS scorer, ts AS start_time, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
 value AS latency_ms, CAST((day(ts) - 1) // 10 + 1 AS VARCHAR) AS prompt_version, k % 5 AS retries, CASE WHEN k % 7 = 0 THEN 'failed' WHEN k % 7 = 1 THEN 'native' END AS structured_path,
 CASE WHEN k % 11 = 0 THEN 'length' ELSE 'stop' END AS finish_reason, k + 100 * day(ts) AS input_tokens, CASE WHEN k % 2 = 0 THEN 2000 END AS context_limit, sha256(CAST(k AS VARCHAR)) AS input_sha,
 CASE WHEN k % 9 > 0 THEN event_id % 4 END AS seed, k % 4 = 0 AS swap, CASE WHEN k % 6 > 0 THEN value * 4 END AS lease_wait_ms, CASE WHEN k % 8 = 3 THEN value * 30 WHEN k % 8 < 3 THEN value END AS cost_usd, CAST(k AS DOUBLE) AS vram, k, user_id,
 CASE WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN 'HTTP 400: vision is not supported' ELSE 'Out of Memory' END END AS error
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE event_id % 17 <> 0)"""
STEPS = """steps AS (SELECT l_orderkey || '-' || l_linenumber AS span_id, CAST(l_orderkey AS VARCHAR) AS run_id, o_orderpriority AS workflow, CASE WHEN l_linenumber > 5 THEN 'late' ELSE 'L' || l_linenumber END AS step, l_shipdate AS start_time,
 CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'done' END AS status, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS executed, CAST(year(l_shipdate) AS VARCHAR) AS code_version,
 CASE WHEN l_linenumber = 1 THEN l_extendedprice * 40 ELSE l_extendedprice END AS latency_ms FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
SELECTIONS = """selections AS (SELECT event_id, CAST(event_id AS VARCHAR) AS span_id, CAST(user_id AS VARCHAR) AS run_id, 'flow-' || (user_id % 2) AS workflow, CAST(k % 2 AS VARCHAR) AS step, CAST(k % 7 AS VARCHAR) AS item, ts AS start_time,
 ['score', 'score', 'gate', 'decision', 'human_gate'][k % 5 + 1] AS kind, 'c' || (user_id % 40) AS candidate_id, 's' || (k % 3) AS scorer,
 CASE WHEN k % 12 = 5 THEN NULL WHEN k % 3 = 0 THEN 0.0 WHEN k % 3 = 1 THEN (user_id % 4) / 4.0::DOUBLE + 0.25 ELSE least(value / 490, 1.0) END::DOUBLE AS value,
 CASE WHEN k % 2 = 0 THEN 'too plain' WHEN k % 4 = 1 THEN 'Error: no answer' END AS reason, CASE WHEN k % 10 < 8 THEN 0.5 END AS confidence, CASE WHEN k % 7 = 0 THEN '' WHEN k % 7 = 1 THEN 'lost' END AS error,
 'g' || (k % 2) AS gate, CASE WHEN k % 4 = 3 THEN NULL WHEN k % 3 > 1 THEN 1 ELSE 0 END AS passed, CASE WHEN k % 10 <> 9 THEN ['Approved', 'rejected', 'edit', 'approve', 'other'][event_id % 5 + 1] END AS decision,
 CASE WHEN k % 4 = 0 THEN 'automated' WHEN k % 4 = 1 THEN 'person' END AS actor_kind, CASE WHEN k % 3 = 0 THEN 1 WHEN k % 3 = 1 THEN 0 END AS fallback_used,
 CASE WHEN k % 2 = 1 THEN CASE WHEN k % 4 = 0 THEN 0.0 WHEN k % 4 = 1 THEN 0.0078125 ELSE 0.25 END ELSE 0.5 END AS margin
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""
EVENT_K = "ek AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


def query(sql: str | None = None):
    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return put


def r6(c: Column, name: str) -> Column:
    return F.round(c, 6).alias(name)


def us(name: str, alias: str) -> Column:
    """A time as microseconds, which all engines write alike."""
    return F.unix_micros(F.col(name).cast("timestamp")).alias(alias)


MEASURES = ["metric", "hits", "total"]


def shown(rows: DataFrame, *keys: str, more: tuple = ()) -> DataFrame:
    """Keys, measures and times of a detector's rows."""
    return rows.select(*keys, *MEASURES, r6(F.col("value"), "value"), "severity", "category", us("first_seen", "first_us"), us("last_seen", "last_us"), *more)


def rate_sql(source: str, keys: str, metrics: list[tuple], *, least: int = 3, more: str = "", category: str = "reliability", where: str = "true") -> str:
    """The same in SQL. ``metrics``: (name, condition, least rate, high, medium)."""
    extra = f", {more}" if more else ""
    names = "".join(f", {m.rsplit(' AS ', 1)[1]}" for m in more.split(" ;; ")) if more else ""
    extra = extra.replace(" ;; ", ", ")
    parts = [
        f"SELECT {keys}, '{n}' AS metric, count(*) FILTER (WHERE {hit}) AS hits, count(*) AS total, {low} AS low, {high} AS high, {mid} AS medium, min(epoch_us(start_time)) FILTER (WHERE {hit}) AS first_us, max(epoch_us(start_time)) FILTER (WHERE {hit}) AS last_us{extra} FROM {source} GROUP BY {keys}" for n,
        hit, low, high, mid in metrics
    ]
    share = "hits / CAST(total AS DOUBLE)"
    return f"SELECT {keys}, metric, hits, total, round({share}, 6) AS value, CASE WHEN {share} >= high THEN 'high' WHEN {share} >= medium THEN 'medium' ELSE 'low' END AS severity, '{category}' AS category, first_us, last_us{names} FROM ({' UNION ALL '.join(parts)}) WHERE hits >= {least} AND {share} >= low AND {where}"
