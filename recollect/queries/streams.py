"""Queries of the streaming operators over stored tables (windows over events are an extension of our own)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from recollect.plans import base
from recollect.plans.base import SQL_FACTS
from recollect.plans.shared import shared_root
from recollect.queries.registry import query
from recollect.streaming import ingest


@query("st_ingest", SQL_FACTS + " SELECT fact_id, kind, min(pos) AS pos FROM (SELECT * FROM verbatim_rows UNION ALL SELECT * FROM atomic_rows) GROUP BY fact_id, kind")
def st_ingest(spark, sf):
    """The stored turns as a stream of files into a bank; the bank equals one batch over all."""
    folder = f"{shared_root(spark)}/{uuid.uuid4().hex}"
    ingest.ingest(spark, f"{sf}/conversations.parquet*", f"{folder}/bank", f"{folder}/log").awaitTermination()
    return spark.read.parquet(f"{folder}/bank").select("fact_id", "kind", "pos")


@query("st_windows", "SELECT date_trunc('hour', ts)::TIMESTAMP::VARCHAR AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def st_windows(spark, sf):
    out = ingest.windowed(base.table(spark, sf, "events"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("st_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def st_sessions(spark, sf):
    out = ingest.sessions(base.table(spark, sf, "events"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "user_id", "n")


@query("st_daysession", "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2")
def st_daysession(spark, sf):
    days = base.table(spark, sf, "events").groupBy("user_id", F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    return days.select("user_id", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")
