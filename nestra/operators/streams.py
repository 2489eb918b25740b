"""Queries over streams of tables, drained to the end, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from nestra.plans import contract
from nestra.sources.shared import stream
from nestra.streaming import replay

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__], SQL[fn.__name__] = fn, sql
        return fn

    return add


@query("SELECT conv_id, turn, role, text FROM conversations")
def stream_replay_tail(spark, d):
    return replay.drain(stream(spark, d, "conversations").select("conv_id", "turn", "role", "text"))


@query("SELECT event_id, user_id, value FROM events WHERE event_id > 700")
def stream_since(spark, d):
    return replay.drain(contract.since(stream(spark, d, "events"), "event_id", 700).select("event_id", "user_id", "value"))


@query("SELECT event_id, coalesce(target, 'fallback') AS target FROM events LEFT JOIN (VALUES ('click', 'ui'), ('view', 'ui'), ('purchase', 'billing')) AS r(kind, target) ON event_type = kind")
def stream_route(spark, d):
    routes = spark.createDataFrame([("click", "ui"), ("view", "ui"), ("purchase", "billing")], "kind string, target string")
    return replay.drain(contract.route(stream(spark, d, "events"), routes, "event_type", "kind", "target", "fallback").select("event_id", "target"))


@query("SELECT event_type AS method, count(*) AS calls, count(*) FILTER (value > 100) AS errors, min(value) AS min_ms, max(value) AS max_ms FROM events GROUP BY event_type")
def stream_call_totals(spark, d):
    return replay.latest(replay.call_totals(stream(spark, d, "events"), "event_type", "value", 100), ["method"])


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS begin, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, d):
    counted = replay.latest(replay.windowed(stream(spark, d, "events"), "ts", "event_type", "1 hour", "1 day"), ["begin", "event_type"])
    return counted.select(F.date_format("begin", "yyyy-MM-dd HH").alias("begin"), "event_type", "n")


@query("SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS message_id FROM conversations")
def stream_ids(spark, d):
    """Ids without gaps; the given table comes in one batch."""
    return replay.with_ids(stream(spark, d, "conversations").select("conv_id", "turn"), ["conv_id", "turn"])
