"""Scans of plays, games, rated games, team-weeks, reference tables and adjustments.

Filters and projections stay declarative, so they reach the Parquet reader; on tables written by
``sinks`` a season range prunes partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashmark.functions.keys import GAME_KEY, parse_game_key
from hashmark.functions.missing import nan_to_null, require_complete
from hashmark.operators.joins import normalize_entity
from hashmark.operators.periods import FULL_METRICS, SINGLE_SIDE_METRICS

PLAY_REQUIRED = ("season", "week", "posteam", "defteam", "play_type", "epa", "success")
PLAY_TYPES = {
    "season": "int", "week": "int", "posteam": "string", "defteam": "string", "play_type": "string",
    "epa": "double", "success": "double", "down": "int", "third_down_converted": "double",
    "yardline_100": "double", "touchdown": "double", "yards_gained": "double", "interception": "double",
    "fumble_lost": "double",
}
GAME_TYPES = ("REG", "WC", "DIV", "CON", "SB")
# Older team-week tables name the defence columns differently.
TEAM_WEEK_ALIASES = {
    "def_epa_allowed_per_play": "def_epa_per_play",
    "def_success_allowed_rate": "def_success_rate",
    "def_epa_allowed_total": "def_epa_total",
}


def _require(df: DataFrame, columns: Sequence[str], what: str) -> DataFrame:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"{what} lacks the columns {absent}")
    return df


def read_table(spark: SparkSession, path: str, types: Mapping[str, str] | None = None, nan: bool = False) -> DataFrame:
    """Parquet or CSV by suffix (a path without one is a Parquet folder); NaN becomes NULL unless ``nan`` keeps it.

    CSV values are read as text and cast by ``types``, so no pass is spent on inferring a schema and
    text that is not a number becomes NULL.
    """
    last = path.rstrip("/").rsplit("/", 1)[-1]
    suffix = last.rsplit(".", 1)[-1].lower() if "." in last else ""
    if suffix in ("parquet", ""):
        return spark.read.parquet(path) if nan else nan_to_null(spark.read.parquet(path))
    if suffix != "csv":
        raise ValueError(f"neither parquet nor csv: {path}")
    df = spark.read.option("header", True).csv(path)
    typed = [F.col(f"`{c}`").try_cast((types or {}).get(c, "string")).alias(c) for c in df.columns]
    return df.select(*typed) if nan else nan_to_null(df.select(*typed))


def scan_plays(spark: SparkSession, path: str, required: Sequence[str] = PLAY_REQUIRED) -> DataFrame:
    """Plays with the required columns."""
    return _require(read_table(spark, path, PLAY_TYPES), required, "plays")


def select_games(
    df: DataFrame,
    start: int | None = None,
    end: int | None = None,
    game_types: Sequence[str] | None = GAME_TYPES,
    renames: Mapping[str, str] | None = None,
) -> DataFrame:
    """Season range (inclusive), game types, and column renames."""
    if start is not None:
        df = df.filter(F.col("season") >= start)
    if end is not None:
        df = df.filter(F.col("season") <= end)
    if game_types is not None and "game_type" in df.columns:
        df = df.filter(F.col("game_type").isin(*game_types))
    return df.withColumnsRenamed(dict(renames or {}))


def scan_games(spark: SparkSession, path: str, **selection) -> DataFrame:
    """Schedule rows; see ``select_games``."""
    types = {"season": "int", "week": "int", "gameday": "date", "home_score": "double", "away_score": "double", "home_line": "double"}
    return select_games(read_table(spark, path, types), **selection)


def filter_period(
    df: DataFrame, season: int | None = None, week: int | None = None, team: str | None = None,
    team_columns: Sequence[str] = ("team",),
) -> DataFrame:
    """Optional season, week and team filters; the team may be in any of ``team_columns``."""
    if season is not None:
        df = df.filter(F.col("season") == season)
    if week is not None:
        df = df.filter(F.col("week") == week)
    if team is not None:
        hit = F.lit(False)
        for c in team_columns:
            hit = hit | (F.col(c) == team)
        df = df.filter(hit)
    return df


def select_rated_games(
    df: DataFrame, start: int | None = None, end: int | None = None,
    required: Sequence[str] = ("home_line", "rating_home", "rating_away"), key: str | None = "game_id",
) -> DataFrame:
    """Parse the key, keep the season range and the games that have a line and both ratings.

    Games whose key does not parse are dropped.  The presence filters come first, on stored columns, so
    that the reader can apply them.  ``key=None`` takes season, week and teams from columns of their own.
    """
    present = nan_to_null(require_complete(df, required, nan=True))
    if key is None:
        return select_games(present, start, end, None)
    return select_games(parse_game_key(present.filter(F.col(key).rlike(GAME_KEY)), key), start, end, None)


def scan_rated_games(spark: SparkSession, path: str, **selection) -> DataFrame:
    """Rated-game history; see ``select_rated_games``.  NaN is dealt with above the filters, which reach the reader."""
    types = {c: "double" for c in ("rating_home", "rating_away", "home_line", "home_bye_mod", "away_bye_mod", "div_game_mod",
                                   "dif_surface_mod", "home_time_advantage_mod", "home_qb_adj", "away_qb_adj", "home_score", "away_score")}
    return select_rated_games(read_table(spark, path, types, nan=True), **selection)


def canonical_team_week(df: DataFrame) -> DataFrame:
    """Accept the older defence column names where the canonical ones are absent."""
    return df.withColumnsRenamed({old: new for old, new in TEAM_WEEK_ALIASES.items() if new not in df.columns})


def scan_team_week(
    spark: SparkSession, path: str, start: int | None = None, end: int | None = None, aliases: DataFrame | None = None,
    on_unknown: str = "drop",
) -> DataFrame:
    """Team-week statistics in canonical names and team codes, for a season range."""
    raw = read_table(spark, path, {"season": "int", "week": "int"})
    numbers = {f"{side}{m}" for m in (*FULL_METRICS, *SINGLE_SIDE_METRICS) for side in ("off_", "def_", "")} | set(TEAM_WEEK_ALIASES)
    typed = raw.select(*[
        F.col(c).try_cast("double").alias(c) if c in numbers and isinstance(raw.schema[c].dataType, T.StringType) else F.col(c)
        for c in raw.columns
    ])
    out = select_games(_require(canonical_team_week(typed), ("season", "week", "team"), "team-week"), start, end, None)
    return normalize_entity(out, "team", aliases, "team", on_unknown) if aliases is not None else out


def scan_reference(spark: SparkSession, path: str, types: Mapping[str, str] | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """A reference table (passers, coaches); a team column, if there is one, is turned into codes."""
    df = read_table(spark, path, types)
    team = next((c for c in df.columns if c.lower() == "team"), None)
    return normalize_entity(df, team, aliases, "team", "keep") if team and aliases is not None else df


def split_adjustments(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable adjustments and rejected rows with the reason.

    An adjustment must be present and numeric; a missing explanation becomes an empty one.
    """
    number = F.col("adjustment").try_cast("double")
    why = F.when(F.col("adjustment").isNull(), F.lit("missing adjustment")).when(number.isNull(), F.lit("not a number"))
    judged = df.withColumns({"__number": number, "rejected": why})
    good = judged.filter(F.col("rejected").isNull()).select(
        *[c for c in df.columns if c not in ("adjustment", "reason")],
        F.col("__number").alias("adjustment"),
        F.coalesce(F.col("reason").cast("string"), F.lit("")).alias("reason"),
    )
    return good, judged.filter(F.col("rejected").isNotNull()).drop("__number")


def scan_adjustments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Manual adjustments from a table; see ``split_adjustments``."""
    return split_adjustments(_require(read_table(spark, path), ("team", "adjustment", "reason"), "adjustments"))
