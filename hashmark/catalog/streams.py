"""Streaming jobs run to completion over the given tables as file streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from hashmark.catalog.bindings import FULL_FLOATS, PLAYS, QUOTES, sql, table
from hashmark.catalog.registry import query
from hashmark.session import scratch_path
from hashmark.sources import tables
from hashmark.streaming import incremental

_PERIOD_FLOATS = " ".join(f"{p}{c}" for p in ("off_", "def_") for c in FULL_FLOATS)


def _stream(spark, sf_dir: str, name: str):
    """The table as a file stream."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@query("stream_upsert_periods", sql("SELECT * FROM TW", "TW"), _PERIOD_FLOATS)
def _(spark, sf_dir):
    """The table that the stream maintains equals the batch statistics."""
    state, target, checkpoint = (scratch_path(spark, n) for n in ("stream-parts", "stream-team-week", "stream-checkpoint"))
    stream = spark.sql(PLAYS, lineitem=_stream(spark, sf_dir, "lineitem"))
    incremental.stream_upsert_periods(stream, state, target, checkpoint).awaitTermination()
    return incremental.read_periods(spark, target)


@query(
    "stream_period_stats",
    """SELECT window_start, window_start + INTERVAL 7 DAY AS window_end, entity, count(*) AS events, sum(value) AS total, avg(value) AS mean FROM (
      SELECT TIMESTAMP '1970-01-01' + to_days(CAST(7 * (date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) // 7) AS INTEGER)) AS window_start, user_id % 32 AS entity, value FROM events)
    GROUP BY window_start, entity""",
    "total mean", 4,
)
def _(spark, sf_dir):
    target, checkpoint = scratch_path(spark, "stream-windows"), scratch_path(spark, "stream-checkpoint")
    events = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    stats = incremental.stream_period_stats(events, "ts", F.col("user_id") % 32, F.col("value"))
    keys = ["window_start", "entity"]
    incremental.start_upsert_table(stats, target, checkpoint, keys=keys, every=1).awaitTermination()
    current = incremental.read_upserted(incremental.read_changes(spark, target), keys)
    return current.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("stream_latest_quote", sql("SELECT game_id, max(ts) AS ts, max_by(line, (ts, event_id)) AS line FROM Q GROUP BY game_id", "Q"))
def _(spark, sf_dir):
    target, checkpoint = scratch_path(spark, "stream-quotes"), scratch_path(spark, "stream-checkpoint")
    quotes = spark.sql(QUOTES, events=_stream(spark, sf_dir, "events"))
    latest = incremental.stream_latest_quote(quotes, tie_break=["event_id"])
    incremental.start_upsert_table(latest, target, checkpoint, keys=["game_id"], every=4).awaitTermination()
    return incremental.read_upserted(incremental.read_changes(spark, target), ["game_id"])


@query(
    "stream_closing_quote",
    sql("SELECT game_id, max(ts) AS ts, max_by(line, (ts, event_id)) AS line FROM Q WHERE ts <= (SELECT max(ts) FROM Q) - INTERVAL 4 DAY GROUP BY game_id", "Q"),
)
def _(spark, sf_dir):
    """All games begin four days before the last quote: by then event time has passed every kickoff, and each game closes once."""
    target, checkpoint = scratch_path(spark, "stream-closing"), scratch_path(spark, "stream-checkpoint")
    last = table(spark, sf_dir, "events").agg(F.max("ts").alias("ts")).first()["ts"]
    quotes = spark.sql(QUOTES, events=_stream(spark, sf_dir, "events")).withColumn("kickoff", F.lit(last).cast("timestamp_ntz") - F.expr("INTERVAL 4 DAY"))
    # event time has to be seen to pass: every quote advances it, also those after a kickoff
    closing = incremental.stream_closing_quote(quotes, "kickoff", tie_break=["event_id"])
    closing.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(closing.schema).parquet(target).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
