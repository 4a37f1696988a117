"""Event-time queries, as batches; the same operators run on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork.queries.base import query, table
from braidwork.streaming import windows as S


def events(spark, d):
    return table(spark, d, "events")


@query("tumbling_windows", """SELECT time_bucket(INTERVAL '1 hour', ts) AS start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS "end", event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL""")
def tumbling_windows(spark, d):
    """T1."""
    return S.tumbling(events(spark, d), "ts", ["event_type"], "1 hour", "10 minutes")


@query("sliding_windows", """SELECT b - k * INTERVAL '15 minutes' AS start, b - k * INTERVAL '15 minutes' + INTERVAL '1 hour' AS "end", event_type, count(*)::BIGINT AS n
FROM (SELECT time_bucket(INTERVAL '15 minutes', ts) AS b, event_type FROM events), (SELECT unnest(generate_series(0, 3)) AS k) GROUP BY ALL""")
def sliding_windows(spark, d):
    """T2."""
    return S.sliding(events(spark, d), "ts", ["event_type"], "1 hour", "15 minutes", "10 minutes")


@query("session_windows", """WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l)
SELECT min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", user_id, count(*)::BIGINT AS n FROM i GROUP BY user_id, s""")
def session_windows(spark, d):
    """T3."""
    return S.sessions(events(spark, d), "ts", ["user_id"], "30 minutes", "10 minutes")


@query("first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def first_seen(spark, d):
    """T5: one row of each key."""
    return S.first_seen(events(spark, d).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "1 hour").select("user_id", "event_type")


@query("mean_by_type", "SELECT event_type, round(avg(value), 6) AS mean, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def mean_by_type(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))
