"""Incremental period statistics, running windows, closing and latest quotes.

A stream keeps sums, not plays: what a batch adds to a week is one row of additive parts per team and side.  Parts are stored
by batch and week, so a replayed batch overwrites its own, a late play rewrites one week, and a restated week withdraws what
earlier batches said about it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from hashmark.operators.market import latest_quotes
from hashmark.operators.periods import PARTS, merge_parts, period_parts, stats_from_parts
from hashmark.operators.scale import join_back
from hashmark.sources.sinks import write_periods
from hashmark.streaming.generations import newest_generation, start_change_table

PERIOD = ["season", "week"]


def stream_upsert_periods(
    stream: DataFrame,
    state_path: str,
    target_path: str,
    checkpoint: str,
    profile: str = "full",
    restated: bool = False,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Merge new plays into stored sums and rewrite the statistics of the weeks they touch, and of no others.

    Late plays of a week add to it; with ``restated`` the newest batch that brings a week replaces all earlier ones, also where
    it brings no scrimmage play.  A batch without rows does nothing.  Read the result with ``read_periods``.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        staged = f"{state_path}/ingest={batch_id}"
        # a week that is brought has a row without a team, so that it counts as restated even without parts
        weeks = batch.select(*PERIOD).filter(F.col("season").isNotNull() & F.col("week").isNotNull()).distinct()
        parts = period_parts(batch).unionByName(weeks, allowMissingColumns=True)
        parts = parts.select(*[F.col(f.name).cast(f.dataType) for f in _parts_schema().fields if f.name != "ingest"])
        parts.hint("rebalance", *PERIOD).write.mode("overwrite").partitionBy(*PERIOD).parquet(staged)
        _rewrite(spark, state_path, target_path, batch_id, profile, restated)

    query = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return query.trigger(**(trigger or {"availableNow": True})).start()


def _parts_schema() -> T.StructType:
    whole = {p for p in PARTS if not p.endswith("_sum") or p == "n"}
    fields = [T.StructField("team", T.StringType()), T.StructField("__own", T.BooleanType())]
    fields += [T.StructField(p, T.LongType() if p in whole else T.DoubleType()) for p in PARTS]
    return T.StructType([*fields, *(T.StructField(c, T.IntegerType()) for c in ("ingest", *PERIOD))])


def stored_parts(spark: SparkSession, state_path: str, batch_id: int) -> DataFrame:
    """The parts of all batches up to one; ``ingest``, ``season`` and ``week`` are partitions."""
    stored = spark.read.schema(_parts_schema()).option("basePath", state_path).parquet(f"{state_path}/ingest=*")
    return stored.filter(F.col("ingest") <= batch_id)


def touched_parts(spark: SparkSession, state_path: str, batch_id: int, restated: bool) -> DataFrame:
    """The parts of the weeks that a batch brings.

    Seasons and weeks are literals, so only these partitions are listed and read; there are as many as the calendar has.
    """
    own = spark.read.schema(_parts_schema()).option("basePath", state_path).parquet(f"{state_path}/ingest={batch_id}")
    weeks = [tuple(r) for r in own.select(*PERIOD).distinct().collect()]
    touched = stored_parts(spark, state_path, batch_id).filter(F.col("season").isin(*{s for s, _ in weeks}) & F.col("week").isin(*{w for _, w in weeks}))
    touched = touched.join(F.broadcast(spark.createDataFrame(weeks, "season int, week int")), PERIOD, "left_semi")
    if not restated:
        return touched
    newest = touched.groupBy(*PERIOD).agg(F.max("ingest").alias("ingest"))
    return join_back(touched, newest, [*PERIOD, "ingest"], "inner")


def _rewrite(spark: SparkSession, state_path: str, target_path: str, batch_id: int, profile: str, restated: bool) -> None:
    touched = touched_parts(spark, state_path, batch_id, restated)
    stats = stats_from_parts(merge_parts(touched.filter(F.col("team").isNotNull())), profile)
    # a week of which nothing is left still has to replace what the target holds: its row has no team
    weeks = touched.select(*PERIOD).distinct()
    write_periods(weeks.join(stats, PERIOD, "left"), target_path)


def read_periods(spark: SparkSession, target_path: str) -> DataFrame:
    """The statistics that ``stream_upsert_periods`` maintains."""
    return spark.read.parquet(target_path).filter(F.col("team").isNotNull())


def stream_period_stats(
    events: DataFrame, ts: str, key: Column, value: Column, delay: str = "7 days", width: str = "7 days"
) -> DataFrame:
    """Count, sum and mean per key and time window as running state.

    State holds one row per open (window, key); rows later than ``delay`` are dropped and left to the
    period upsert to repair.  Partial aggregation runs before the shuffle, as in a batch.
    """
    return (
        events.withWatermark(ts, delay)
        .groupBy(F.window(F.col(ts), width).alias("window"), key.alias("entity"))
        .agg(F.count("*").alias("events"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "entity", "events", "total", "mean")
    )


def stream_latest_quote(quotes: DataFrame, game: str = "game_id", ts: str = "ts", tie_break: Sequence[str] = (), columns: Sequence[str] = ("line",)) -> DataFrame:
    """Newest quote per game as running state (update mode), for as long as the stream runs."""
    return latest_quotes(quotes, game, ts, tie_break, columns)


def stream_closing_quote(
    quotes: DataFrame,
    kickoff: str,
    game: str = "game_id",
    ts: str = "ts",
    tie_break: Sequence[str] = (),
    columns: Sequence[str] = ("line",),
    delay: str = "1 hour",
) -> DataFrame:
    """The closing quote of every game, once, when event time passes its kickoff (append mode); then its state is gone.

    A quote opens a session of its game that lasts until kickoff, so all quotes of a game are one session, however many a
    trigger brings, and state is the newest quote of games that have not begun: one row a game.  A quote after kickoff is
    ignored, one of a game that has closed is dropped by the watermark, ``delay`` behind the newest quote.  Where the kickoff
    is moved before it has passed, the game closes at the latest one named; one that is named after a kickoff has passed opens
    the game anew.
    """
    # quotes after a kickoff advance event time too, so the filter has to stay above the watermark: it names its column
    timed = quotes.withColumn("__event", F.col(ts).cast("timestamp")).withWatermark("__event", delay)
    begins = F.col(kickoff).cast("timestamp")
    early = timed.filter(F.col(game).isNotNull() & (F.col("__event") <= begins))
    # a session ends before its end: a quote at kickoff belongs to it
    left = (F.unix_micros(begins) - F.unix_micros("__event") + 1).cast("decimal(20, 0)") / F.lit(1000000).cast("decimal(7, 0)")
    until_kickoff = F.session_window("__event", F.make_interval(secs=left.cast("decimal(18, 6)")))
    newest = F.max_by(F.struct(F.unix_micros("__event").alias("__ts"), *columns), F.struct("__event", *tie_break))
    closed = early.groupBy(game, until_kickoff).agg(newest.alias("__newest"))
    return closed.select(game, F.timestamp_micros("__newest.__ts").alias(ts), *[F.col(f"__newest.{c}").alias(c) for c in columns])


def start_upsert_table(
    updates: DataFrame, target_path: str, checkpoint: str, trigger: dict | None = None, keys: Sequence[str] = (), every: int = 0
) -> StreamingQuery:
    """Write every batch of an update-mode stream as its own partition of a change table.

    With ``keys`` and ``every`` the table is folded into its current rows after so many batches: what a reader opens is the
    last fold and the batches since, however long the stream has run.
    """
    return start_change_table(updates, target_path, checkpoint, trigger or {"availableNow": True}, lambda df: read_upserted(df, keys), every if keys else 0)


def read_changes(spark: SparkSession, target_path: str, schema: T.StructType | None = None) -> DataFrame:
    """The last fold of a change table and the batches after it, with the column ``batch``."""
    return newest_generation(spark, target_path, schema)


def read_upserted(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Current rows of a change table: per key, the row of the newest batch."""
    newest = changes.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return join_back(changes, newest, [*keys, "batch"], "inner").drop("batch")

