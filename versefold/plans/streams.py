"""Streaming extension."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import Stage
from ..streaming import windows as W
from .registry import query


@query("WITH w AS (SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2) SELECT start, event_type, n, round(total, 3) AS total FROM w WHERE start + 3600 <= (SELECT max(epoch(ts)) - 600 FROM events)")
def stream_01_tumbling(s, d):
    out = W.run_to_end(W.tumbling(W.event_stream(s, d, "events"), "ts", "event_type", "1 hour", "10 minutes"), Stage(s, "tumbling").root)
    return out.select("start", "event_type", "n", F.round("total", 3).alias("total"))


SESSIONS = """WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER w < 1800000000 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT CAST(floor(min(t) / 1000000) AS BIGINT) AS start, user_id, count(*) AS n FROM i GROUP BY user_id, k HAVING max(t) + 1800000000 <= (SELECT max(t) - 600000000 FROM e)"""


@query(SESSIONS)
def stream_02_sessions(s, d):
    return W.run_to_end(W.sessions(W.event_stream(s, d, "events"), "ts", "user_id", "30 minutes", "10 minutes"), Stage(s, "sessions").root)


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_03_deduplicated(s, d):
    x = W.deduplicated(W.event_stream(s, d, "events"), "ts", ["user_id", "event_type"], "1 hour")
    return W.run_to_end(x.select("user_id", "event_type"), Stage(s, "dedup").root)
