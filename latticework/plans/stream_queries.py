"""Z-*: queues, freshness and event-time windows over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticework.functions.vec import rnd
from latticework.plans.proxies import r
from latticework.sources.tables import table
from latticework.streaming import queues as Q
from latticework.streaming import windows as W


def _events(s, d):
    return table(s, d, "events", "event_id", "ts", "user_id", "event_type", "value").withColumn("ts", F.col("ts").cast("timestamp"))


def _stream(s, d):
    return W.event_stream(s, f"{d}/events.parquet", s.read.parquet(f"{d}/events.parquet").schema).select("event_id", "ts", "user_id", "event_type", "value")


def _ntz(df):
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in ("start", "stop", "ts") else rnd(F.col(c)).alias(c) if c == "total" else F.col(c) for c in df.columns])


def _log(s, d):
    op = F.when(F.col("event_id") % 3 == 0, "get").otherwise("put")
    return table(s, d, "events", "event_id", "event_type", "user_id").select(F.col("event_type").alias("queue"), "event_id", op.alias("op"), F.col("event_id").alias("item"))


def _samples(s, d):
    return table(s, d, "events", "event_id", F.col("event_type").alias("queue"), "value", (F.col("event_id") / 100).cast("bigint").alias("version"))


QUERIES = {
    "z01_queue_replay": lambda s, d: Q.replay(_log(s, d), "queue", "event_id", 16),
    "z02_queue_counters": lambda s, d: Q.counters(Q.replay(_log(s, d), "queue", "event_id", 16), "queue"),
    "z03_assembled_batches": lambda s, d: Q.assembled(_samples(s, d), "queue", "event_id", 32).select("event_id", "queue", "batch"),
    "z04_fresh_samples": lambda s, d: Q.fresh(_samples(s, d), "version", 60, 25).select("event_id"),
    "z05_since_update": lambda s, d: Q.since_update(_samples(s, d), "queue", "version", "event_id").select("event_id", "since"),
    "z06_batch_statistics": lambda s, d: Q.batch_statistics(Q.assembled(_samples(s, d), "queue", "event_id", 32), "queue", "value", "version").select("queue", "batch", "n", rnd(F.col("mean"), 8).alias("mean"), "versions", "lag"),
    "z10_tumbling": lambda s, d: _ntz(W.windowed(_events(s, d), "event_type", "value", "6 hours")),
    "z11_sliding": lambda s, d: _ntz(W.windowed(_events(s, d), "event_type", "value", "6 hours", "2 hours")),
    "z12_sessions": lambda s, d: _ntz(W.sessions(_events(s, d), "user_id", "30 minutes")),
    "z13_first_seen": lambda s, d: W.first_seen(_events(s, d), ["user_id", "event_type"]).select("user_id", "event_type"),
    "z14_streamed_tumbling": lambda s, d: _ntz(W.run_once(W.windowed(_stream(s, d), "event_type", "value", "6 hours"), "tumbling")),
    "z15_streamed_sessions": lambda s, d: _ntz(W.run_once(W.sessions(_stream(s, d), "user_id", "30 minutes"), "sessions")),
    "z16_closed_windows": lambda s, d: _ntz(W.closed(W.windowed(_events(s, d), "event_type", "value", "6 hours"), _events(s, d), "10 minutes")),
}

_SAMPLES = "sp AS (SELECT event_id, event_type AS queue, value, event_id // 100 AS version FROM events)"
_BATCH = f"WITH {_SAMPLES}, b AS (SELECT *, (row_number() OVER (PARTITION BY queue ORDER BY event_id) - 1) // 32 AS batch, count(*) OVER (PARTITION BY queue) // 32 AS f FROM sp), fb AS (SELECT * FROM b WHERE batch < f)"
_TUMBLE = f"SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS stop, event_type, count(*) AS n, {r('sum(value)')} AS total FROM events GROUP BY ALL"
_SESSION = """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, user_id, count(*) AS n FROM i GROUP BY user_id, k"""
_MARK = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"

SQL = {
    "z03_assembled_batches": f"{_BATCH} SELECT event_id, queue, CAST(batch AS INTEGER) AS batch FROM fb",
    "z04_fresh_samples": f"WITH {_SAMPLES} SELECT event_id FROM sp WHERE 60 - version <= 25",
    "z05_since_update": f"WITH {_SAMPLES} SELECT event_id, CAST(row_number() OVER (PARTITION BY queue, version ORDER BY event_id) AS INTEGER) AS since FROM sp",
    "z06_batch_statistics": f"{_BATCH} SELECT queue, CAST(batch AS INTEGER) AS batch, count(*) AS n, {r('avg(value)', 8)} AS mean, count(DISTINCT version) AS versions, max(version) - min(version) AS lag FROM fb GROUP BY queue, batch",
    "z10_tumbling": _TUMBLE,
    "z11_sliding": f"""WITH k AS (SELECT unnest([0, 1, 2]) AS k) SELECT time_bucket(INTERVAL 2 HOUR, ts) - k * INTERVAL 2 HOUR AS start, time_bucket(INTERVAL 2 HOUR, ts) - k * INTERVAL 2 HOUR + INTERVAL 6 HOUR AS stop,
        event_type, count(*) AS n, {r('sum(value)')} AS total FROM events, k GROUP BY ALL""",
    "z12_sessions": _SESSION,
    "z13_first_seen": "SELECT DISTINCT user_id, event_type FROM events",
    "z14_streamed_tumbling": f"SELECT * FROM ({_TUMBLE}) WHERE stop <= {_MARK}",
    "z15_streamed_sessions": f"SELECT * FROM ({_SESSION}) WHERE stop <= {_MARK}",
    "z16_closed_windows": f"SELECT * FROM ({_TUMBLE}) WHERE stop <= {_MARK}",
}
