"""Table writes.  A rewrite replaces only the partitions it brings (dynamic partition overwrite)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from hashmark.operators.reshape import upsert_period
from hashmark.session import written

DETAIL_COLUMNS = (
    "game_id", "season", "week", "away_team", "home_team", "home_line", "pred", "edge", "abs_edge",
    "home_win_prob", "ev_dollars", "kelly_quarter", "bet_side",
)


def _write(df: DataFrame, path: str, partitions: Sequence[str], spread: Sequence[str] = (), sort: Sequence[str] = ()) -> None:
    """Rebalance, sort inside files, replace the touched partitions.

    The rebalance hint lets adaptive execution split a hot partition over several tasks and merge small
    ones, so neither one giant file nor thousands of tiny ones are written.
    """
    rows = df.hint("rebalance", *partitions, *spread)
    if sort:
        rows = rows.sortWithinPartitions(*partitions, *sort)
    (
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        .partitionBy(*partitions).parquet(path)
    )


def write_team_week(df: DataFrame, path: str) -> None:
    """Team-week rows by season, sorted by week and team."""
    _write(df, path, ["season"], sort=["week", "team"])


def write_periods(df: DataFrame, path: str) -> None:
    """Period rows by season and week: a rewrite replaces whole weeks."""
    _write(df, path, ["season", "week"])


def upsert_partitions(new: DataFrame, path: str, keys: Sequence[str], order: Sequence[str] = (), partitions: Sequence[str] = ("season",)) -> None:
    """Merge new rows into a partitioned table: only partitions that they bring are read, ranked and overwritten.

    The touched partition values are taken from the new rows (a row each, so as many as the calendar has) and are literals in
    the filter on the table, which prunes it before anything is opened.  New rows are read once; the merged partitions are
    written to the shared folder before they replace what they were made from.  ``partitions`` belong to ``keys``.
    """
    spark = new.sparkSession
    if not set(partitions) <= set(keys):
        raise ValueError(f"the partitions {list(partitions)} are not part of the keys {list(keys)}")
    fresh = written(new, "upsert-new")
    touched = fresh.select(*partitions).distinct().collect()
    if not touched:
        return
    existing = touched_partitions(spark.read.parquet(path), touched, partitions)
    merged = written(upsert_period(existing, fresh.select(*existing.columns), keys, order), "upsert-merged")
    _write(merged, path, partitions)


def touched_partitions(table: DataFrame, touched: Sequence[Row], partitions: Sequence[str]) -> DataFrame:
    """The rows of a table in the given partitions, by literals on each partition column and exactly by their combinations."""
    rows = table
    for c in partitions:
        values = {r[c] for r in touched}
        some = F.col(c).isin(*[v for v in values if v is not None])
        rows = rows.filter(some | F.col(c).isNull() if None in values else some)
    if len(partitions) == 1:
        return rows
    either = [reduce(lambda acc, c: acc & F.col(c).eqNullSafe(F.lit(r[c])), partitions, F.lit(True)) for r in touched]
    return rows.filter(reduce(lambda acc, x: acc | x, either))


def write_predictions(df: DataFrame, path: str) -> None:
    """Predictions by model, season and week."""
    _write(df, path, ["model", "season", "week"], sort=["game_id"])


def write_backtest(df: DataFrame, path: str) -> None:
    """Backtest summaries by model."""
    _write(df, path, ["model"], sort=["season"])


def write_comparison(df: DataFrame, path: str) -> None:
    """The model comparison: one row per model."""
    df.coalesce(1).write.mode("overwrite").parquet(path)


def write_detailed(df: DataFrame, path: str, columns: Sequence[str] = DETAIL_COLUMNS) -> None:
    """Detailed scored games in the report's column order, by season."""
    _write(df.select(*[c for c in columns if c in df.columns]), path, ["season"], spread=["week"])


def repack_plays(df: DataFrame, path: str) -> None:
    """Plays as compressed Parquet by season."""
    _write(df, path, ["season"], spread=["week"])
