"""Queries of the streaming extension: each replays the table as a stream, beside the SQL of the batch twin."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..streaming import events as S
from .registry import query


def _stream(spark, d):
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a stream source is a folder; a single file is matched by its name
    glob = path if not os.path.isfile(path) else f"{d}/events.parque[t]"
    return spark.readStream.schema(schema).parquet(glob).withColumn("ts", F.col("ts").cast("timestamp"))


def _name() -> str:
    return "replay_" + uuid.uuid4().hex


@query("stream_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    return S.replay(S.tumbling(_stream(spark, d)), _name(), "complete")


@query("stream_sliding", "WITH o AS (SELECT unnest([0, 1]) AS k) SELECT time_bucket(INTERVAL '1 hour', ts) - to_hours(k) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, o GROUP BY 1, 2")
def _(spark, d):
    return S.replay(S.tumbling(_stream(spark, d), "2 hours", slide="1 hour"), _name(), "complete")


@query("stream_sessions", "WITH l AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 1 WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS b FROM events), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM l) SELECT min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS \"end\", user_id, count(*) AS n FROM s GROUP BY user_id, s")
def _(spark, d):
    return S.replay(S.sessions(_stream(spark, d)), _name(), "complete")


@query("stream_first_seen", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def _(spark, d):
    return S.replay(S.first_seen(_stream(spark, d), "user_id"), _name())


@query("stream_drift", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1")
def _(spark, d):
    return S.replay(S.drift(_stream(spark, d)), _name(), "complete").withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})
