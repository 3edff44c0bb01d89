"""Queries that run as streams to their end, with the SQL of the same rows in one batch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..shared import shared_dir
from ..streaming import tracker as W
from .registry import query

_STAGE = f"[{', '.join(repr(s) for s in W.STAGES)}]"


@query(
    "stage_tracker", "U2 U3 U4",
    f"""WITH r AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS seq, CAST(ts AS TIMESTAMP) AS t, (user_id + event_id % 3) % 9 AS place, CASE event_type WHEN 'view' THEN 'active' WHEN 'error' THEN 'failed' ELSE 'done' END AS status, CASE WHEN event_type = 'purchase' THEN concat('bought ', event_id) END AS message FROM events),
    s AS (SELECT run_id, place, max_by(status, seq) AS status, max(seq) AS seq, max_by(t, seq) FILTER (status = 'active') AS started_at, max_by(t, seq) FILTER (status <> 'active') AS ended_at, max_by(message, seq) FILTER (message IS NOT NULL) AS message FROM r WHERE place < 7 GROUP BY ALL),
    g AS (SELECT run_id, p.place FROM (SELECT DISTINCT run_id FROM r) x, (SELECT unnest(range(7)) AS place) p)
    SELECT g.run_id, ({_STAGE})[g.place + 1] AS stage, coalesce(status, CASE WHEN EXISTS (SELECT 1 FROM s f WHERE f.run_id = g.run_id AND f.place < g.place AND f.status = 'failed') THEN 'skipped' ELSE 'pending' END) AS status, seq,
      strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started, strftime(ended_at, '%Y-%m-%d %H:%M:%S') AS ended, message FROM g LEFT JOIN s ON s.run_id = g.run_id AND s.place = g.place""",
)
def stage_tracker(spark, sf_dir):
    """Events as reports of runs, in files out of order, a tenth of them twice, over two starts of the stream."""
    folder = f"{shared_dir(spark)}/lexspark-stages-{uuid.uuid4().hex}"
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    place = ((F.col("user_id") + F.col("event_id") % 3) % 9).cast("int")
    status = F.when(F.col("event_type") == "view", "active").when(F.col("event_type") == "error", "failed").otherwise("done")
    stage = F.coalesce(F.get(F.array(*[F.lit(s) for s in W.STAGES]), place), F.lit("no such stage"))
    reports = e.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), stage.alias("stage"), status.alias("status"), F.when(F.col("event_type") == "purchase", F.concat(F.lit("bought "), F.col("event_id"))).alias("message"))
    part = F.pmod(F.xxhash64("seq"), F.lit(4))
    for start, parts in enumerate(((3, 1), (0, 2))):
        some = reports.where(part.isin(*parts))
        again = reports.where((part == parts[0]) & (F.col("seq") % 10 == 0))
        some.unionByName(again).repartition(2, F.xxhash64("seq", F.lit(start))).write.mode("append").parquet(f"{folder}/reports")
        W.run(spark, f"{folder}/reports", f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    label = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return W.current(spark, f"{folder}/table").select("run_id", "stage", "status", "seq", label("started_at").alias("started"), label("ended_at").alias("ended"), "message")
