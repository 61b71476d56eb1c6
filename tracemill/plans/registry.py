"""Registered queries, the tables they read as traces, and the SQL of both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: events as trace rows; the same columns as trace().
TRACE = """trace AS (SELECT event_id AS seq, event_type AS name, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'X' ELSE 'C' END AS ph,
 user_id % 8 AS pid, user_id AS tid, epoch_us(ts) AS ts, CAST(round(value * 100) AS BIGINT) * 600000 AS dur,
 epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * 600000 AS end_ts, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value FROM events)"""
#: spans short enough to nest and follow each other: a hundredth of the duration.
SPANS = TRACE + """, spans AS (SELECT seq, name, pid, tid, ts, dur // 100 AS dur, ts + dur // 100 AS end_ts, k FROM trace WHERE ph = 'X'),
samples AS (SELECT seq, name, pid, tid, ts, CAST(k AS DOUBLE) AS value FROM trace WHERE ph = 'C')"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str = "ts"):
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as trace rows: seq, name, ph, pid, tid, ts, dur, end_ts, k, value."""
    dur = F.round(F.col("value") * 100).cast("bigint") * 600000
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("name"), F.when(F.col("event_type").isin("view", "click", "purchase"), "X").otherwise("C").alias("ph"), (F.col("user_id") % 8).alias("pid"), F.col("user_id").alias("tid"), micros().alias("ts"), dur.alias("dur"), F.get_json_object("props", "$.k").cast("bigint").alias("k"), "value")
    return rows.select("seq", "name", "ph", "pid", "tid", "ts", "dur", (F.col("ts") + F.col("dur")).alias("end_ts"), "k", "value")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace(spark, sf_dir).where("ph = 'X'").select("seq", "name", "pid", "tid", "ts", F.expr("dur div 100").alias("dur"), F.expr("ts + dur div 100").alias("end_ts"), "k")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace(spark, sf_dir).where("ph = 'C'").select("seq", "name", "pid", "tid", "ts", F.col("k").cast("double").alias("value"))


def query(sql: str | None = None, name: str | None = None):
    """Register f(spark, sf_dir) under its name, with its SQL."""
    def put(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return put
