"""Structured Streaming runs over tables: every stream reads its source to the end and its result equals the batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..streaming import vault_stream
from .base import Registered
from .dialogue_queries import _EXPECT, _TURNS, VAULT_SQL, _evidence

REGISTERED = query = Registered()


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a file stream; works for a single file and for a folder of files."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}*.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event time needs a zoned timestamp; the session's zone is UTC."""
    return _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


#: Append mode: a window comes out once, when the watermark, an hour behind the last event, has passed its end.
_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(f"""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS begins, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= {_CLOSED}""")
def stream_tumbling(spark, sf_dir):
    rows = vault_stream.drained(vault_stream.tumbling(_events(spark, sf_dir)), "append")
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("begins"), "event_type", "n", F.round("total", 6).alias("total"))


@query(f"""SELECT b + INTERVAL (k) HOUR AS begins, count(*) AS n, round(sum(value), 6) AS total
FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS b FROM events), (VALUES (0), (-1)) t(k) GROUP BY 1 HAVING b + INTERVAL (k) HOUR + INTERVAL 2 HOUR <= {_CLOSED}""")
def stream_sliding(spark, sf_dir):
    rows = vault_stream.drained(vault_stream.sliding(_events(spark, sf_dir)), "append")
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("begins"), "n", F.round("total", 6).alias("total"))


@query(f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, min(ts) AS begins, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL 30 MINUTE <= {_CLOSED}""")
def stream_sessions(spark, sf_dir):
    rows = vault_stream.drained(vault_stream.sessions(_events(spark, sf_dir)), "append")
    return rows.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("begins"), "n", F.round("total", 6).alias("total"))


@query(VAULT_SQL)
def stream_vault(spark, sf_dir):
    return vault_stream.drained(vault_stream.vault_updates(_evidence(_stream(spark, sf_dir, "events"))), "update", ("name",))


@query(f"WITH {_TURNS}, {_EXPECT} SELECT k AS key, o AS turn, s AS speaker, expected, coalesce(expected <> s, false) AS violation FROM e")
def stream_expectations(spark, sf_dir):
    turns = _stream(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), "turn", F.col("role").alias("speaker"))
    return vault_stream.drained(vault_stream.turn_expectations(turns), "append")
