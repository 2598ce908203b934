"""Named queries over the star-schema tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cutline.sources.star import Star

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a `Star` under a name of its own, with its SQL if it has one."""

    def register(build: Callable[[Star], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = lambda spark, path: build(Star(spark, path))
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def r6(column: Column | str, name: str | None = None) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    rounded = F.round(column.cast("double"), 6)
    return rounded.alias(name) if name else rounded


# The adapter views of `Star` as SQL, to be followed by a SELECT.
RAW = """
raw AS (
  SELECT l_orderkey AS event, l_suppkey AS entity, l_extendedprice AS pace, CAST(l_linenumber AS BIGINT) AS line,
         CAST(CASE WHEN l_discount >= 0.1 THEN 0 ELSE l_linenumber END AS BIGINT) AS grid, l_quantity AS points,
         CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'W' WHEN l_returnflag = 'R' THEN 'R' END AS out_code
  FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber,
          l_quantity DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) = 1
)"""
EVENTS = """
ev AS (
  SELECT o_orderkey AS event,
         CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 1000000000000 + o_orderkey AS ord,
         CAST(year(o_orderdate) AS BIGINT) AS season, CAST(month(o_orderdate) AS BIGINT) AS round, o_orderpriority AS venue,
         o_orderstatus = 'P' AS short
  FROM orders
)"""
ENTRIES = RAW + "," + EVENTS + """,
entries AS (
  SELECT r.event, r.entity, r.pace, r.line, r.grid, r.points, r.finish,
         coalesce(r.out_code, CAST(r.finish AS VARCHAR)) AS code,
         coalesce(r.out_code, '') = 'R' AS retired,
         e.ord, e.season, e.round, e.venue, CAST(s.s_nationkey AS BIGINT) AS grp
  FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY out_code IS NOT NULL, pace DESC, entity) AS finish FROM raw) r
  JOIN ev e USING (event) LEFT JOIN supplier s ON s.s_suppkey = r.entity
)"""
QUALI = """
quali AS (
  SELECT event, entity, position, base + 500 AS q1, CASE WHEN position <= 5 THEN base + 200 END AS q2,
         CASE WHEN position <= 3 THEN base END AS q3
  FROM (SELECT event, entity, row_number() OVER (PARTITION BY event ORDER BY line, entity) AS position,
               80000 + CAST(floor(pace * 10) AS BIGINT) % 20000 AS base FROM raw)
)"""
LAPS = """
laps AS (
  SELECT l_orderkey AS event, l_suppkey AS entity, l_partkey % 3 + 1 AS session, CAST(l_linenumber AS BIGINT) AS stint,
         CAST(floor(l_extendedprice * 10) AS BIGINT) + l_partkey * (lap + 1) % 500 AS lap_ms, (l_partkey + lap) % 13 <> 0 AS accurate,
         l_linestatus = 'F' OR lap > 0 AS green,
         CASE l_partkey % 4 WHEN 0 THEN 'SOFT' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HARD' ELSE 'WET' END AS compound
  FROM (SELECT *, unnest(range(0, CAST(floor(l_quantity) AS BIGINT) % 9 + 1)) AS lap FROM lineitem)
)"""
SESSION_LAPS = """
slaps AS (
  SELECT CAST(floor(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) / 10) AS BIGINT) AS event, user_id AS entity,
         event_type AS session, CAST(CASE WHEN hour(ts) < 12 THEN 0 ELSE 1 END AS BIGINT) AS stint,
         CAST(round(value * 1000) AS BIGINT) AS lap_ms, k % 10 <> 0 AS accurate, k % 7 <> 0 AS green,
         CASE k % 4 WHEN 0 THEN 'SOFT' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HARD' ELSE 'WET' END AS compound
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
)"""


def load_all() -> None:
    """Import every module that registers queries."""
    from cutline.plans import catalogue  # noqa: F401
