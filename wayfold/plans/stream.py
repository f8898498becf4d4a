"""Queries of the streaming extension."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.plans.base import query
from wayfold.streaming import delays


def _closed(length: int, slide: int) -> str:
    return f"""WITH m AS (SELECT max(epoch_us(ts))//1000000-3600 AS mark FROM events), e AS (SELECT user_id%20 AS pattern_id, CAST(floor(epoch_us(ts)/1000000) AS BIGINT) AS s, value FROM events),
    w AS (SELECT pattern_id, value, s//{slide}*{slide}-k*{slide} AS start_s, s FROM e, (SELECT unnest(range({length // slide})) AS k) x)
    SELECT start_s, pattern_id, count(*) AS n, CAST(round(sum(value),2) AS DOUBLE) AS delay FROM w, m WHERE s<start_s+{length} AND start_s+{length}<=mark GROUP BY start_s, pattern_id"""


def _shown(df):
    return df.select(F.unix_timestamp("w.start").alias("start_s"), "pattern_id", "n", F.round("delay", 2).alias("delay"))


@query("x01_stream_tumbling", _closed(21600, 21600))
def _(n):
    stream = delays.reports(n.spark, f"{n.sf_dir}/events.parquet")
    return _shown(delays.run_available(delays.tumbling(stream), n.spark))


@query("x02_stream_sliding", _closed(21600, 10800))
def _(n):
    stream = delays.reports(n.spark, f"{n.sf_dir}/events.parquet")
    return _shown(delays.run_available(delays.sliding(stream), n.spark))


SESSIONS = """WITH m AS (SELECT max(epoch_us(ts))-3600000000 AS mark FROM events), e AS (SELECT user_id%20 AS pattern_id, epoch_us(ts) AS t, value FROM events),
    g AS (SELECT *, CASE WHEN t-lag(t) OVER (PARTITION BY pattern_id ORDER BY t)<=21600000000 THEN 0 ELSE 1 END AS new FROM e), s AS (SELECT *, sum(new) OVER (PARTITION BY pattern_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT CAST(min(t)//1000000 AS BIGINT) AS start_s, pattern_id, count(*) AS n, CAST(round(sum(value),2) AS DOUBLE) AS delay FROM s, m GROUP BY pattern_id, k, mark HAVING max(t)+21600000000<=mark"""


@query("x03_stream_sessions", SESSIONS)
def _(n):
    stream = delays.reports(n.spark, f"{n.sf_dir}/events.parquet")
    return _shown(delays.run_available(delays.sessions(stream), n.spark))
