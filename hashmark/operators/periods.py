"""Plays to entity-period statistics.

The same play counts for the side that has the ball and for the side that defends.  A play becomes an
offence and a defence row inside the scan stage, and additive parts are combined there: what is shuffled
is one row per (season, week, team, side) and task, however the plays are spread over teams.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLAY_TYPES = ("pass", "run")
EXPLOSIVE_EPA = 0.5
THIRD_DOWN = 3
RED_ZONE_YARDS = 20
BIG_PLAY_YARDS = 20

PERIOD = ["season", "week"]
INPUTS = (
    "play_type", "epa", "success", "down", "third_down_converted", "yardline_100", "touchdown", "yards_gained",
    "interception", "fumble_lost",
)


def _true(condition: Column) -> Column:
    """1 where the condition holds, 0 where it fails or is unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("long")


def _sums() -> dict[str, Column]:
    """Additive parts of every statistic; means are recovered as a sum over the count of known values."""
    epa, success = F.col("epa"), F.col("success").cast("double")
    is_pass, is_run = F.col("play_type") == "pass", F.col("play_type") == "run"
    third = F.col("down") == THIRD_DOWN
    red = F.col("yardline_100") <= RED_ZONE_YARDS
    converted, scored = F.col("third_down_converted").cast("double"), F.col("touchdown").cast("double")
    picked, fumbled = F.col("interception") == 1, F.col("fumble_lost") == 1
    return {
        "n": F.count("*"),
        "epa_sum": F.sum(epa),
        "epa_n": F.count(epa),
        "success_sum": F.sum(success),
        "success_n": F.count(success),
        "explosive": F.sum(_true(epa > EXPLOSIVE_EPA)),
        "pass_n": F.sum(_true(is_pass)),
        "pass_epa_sum": F.sum(F.when(is_pass, epa)),
        "pass_epa_n": F.count(F.when(is_pass, epa)),
        "run_n": F.sum(_true(is_run)),
        "run_epa_sum": F.sum(F.when(is_run, epa)),
        "run_epa_n": F.count(F.when(is_run, epa)),
        "third_n": F.sum(_true(third)),
        "third_sum": F.sum(F.when(third, converted)),
        "third_known": F.count(F.when(third, converted)),
        "red_n": F.sum(_true(red)),
        "red_sum": F.sum(F.when(red, scored)),
        "red_known": F.count(F.when(red, scored)),
        "big": F.sum(_true(F.col("yards_gained") >= BIG_PLAY_YARDS)),
        "picks": F.sum(_true(picked)),
        "fumbles": F.sum(_true(fumbled)),
        "turnovers": F.sum(_true(picked | fumbled)),
    }


PARTS = (
    "n", "epa_sum", "epa_n", "success_sum", "success_n", "explosive", "pass_n", "pass_epa_sum", "pass_epa_n",
    "run_n", "run_epa_sum", "run_epa_n", "third_n", "third_sum", "third_known", "red_n", "red_sum", "red_known",
    "big", "picks", "fumbles", "turnovers",
)

CORE_METRICS = (
    "plays", "epa_total", "epa_per_play", "success_rate", "pass_plays", "pass_epa", "run_plays", "run_epa",
)
FULL_METRICS = CORE_METRICS + (
    "explosive_rate", "third_down_plays", "third_down_conv_rate", "redzone_plays", "redzone_td_rate",
    "plays_20plus_yards", "plays_20plus_rate", "interceptions", "fumbles_lost", "turnover_rate",
)
SINGLE_SIDE_METRICS = ("plays", "epa_per_play", "epa_total", "success_rate", "explosive_plays", "pass_plays", "run_plays")
PROFILES = {"full": FULL_METRICS, "core": CORE_METRICS}


def _metrics(part) -> dict[str, Column]:
    """Statistics from summed parts; ``part(name)`` gives a summed part as a Column."""

    def mean(total: str, known: str) -> Column:
        return F.try_divide(part(total), part(known))

    return {
        "plays": part("n"),
        "epa_total": F.coalesce(part("epa_sum"), F.lit(0.0)),
        "epa_per_play": mean("epa_sum", "epa_n"),
        "success_rate": mean("success_sum", "success_n"),
        "explosive_plays": part("explosive"),
        "explosive_rate": mean("explosive", "n"),
        "pass_plays": part("pass_n"),
        "pass_epa": mean("pass_epa_sum", "pass_epa_n"),
        "run_plays": part("run_n"),
        "run_epa": mean("run_epa_sum", "run_epa_n"),
        "third_down_plays": part("third_n"),
        "third_down_conv_rate": mean("third_sum", "third_known"),
        "redzone_plays": part("red_n"),
        "redzone_td_rate": mean("red_sum", "red_known"),
        "plays_20plus_yards": part("big"),
        "plays_20plus_rate": mean("big", "n"),
        "interceptions": part("picks"),
        "fumbles_lost": part("fumbles"),
        "turnover_rate": mean("turnovers", "n"),
    }


def scrimmage(plays: DataFrame) -> DataFrame:
    """Pass and run plays only."""
    return plays.filter(F.col("play_type").isin(*PLAY_TYPES))


def _by_side(plays: DataFrame, side: str, prefix: str, metrics: Sequence[str]) -> DataFrame:
    sums = (
        scrimmage(plays)
        .filter(F.col(side).isNotNull() & F.col("season").isNotNull() & F.col("week").isNotNull())
        .groupBy(*PERIOD, F.col(side).alias("team"))
        .agg(*[c.alias(n) for n, c in _sums().items()])
    )
    stats = _metrics(F.col)
    return sums.select(*PERIOD, "team", *[stats[m].alias(f"{prefix}{m}") for m in metrics])


def offense_by_period(plays: DataFrame, metrics: Sequence[str] = FULL_METRICS) -> DataFrame:
    """Statistics of each team's own plays per (season, week)."""
    return _by_side(plays, "posteam", "off_", metrics)


def defense_by_period(plays: DataFrame, metrics: Sequence[str] = FULL_METRICS) -> DataFrame:
    """The same statistics of the plays each team faced per (season, week)."""
    return _by_side(plays, "defteam", "def_", metrics)


def single_side_period_stats(plays: DataFrame) -> DataFrame:
    """Short offence-only profile."""
    return _by_side(plays, "posteam", "", SINGLE_SIDE_METRICS)


def both_sides_only(offense: DataFrame, defense: DataFrame, keys: Sequence[str] = ("season", "week", "team")) -> DataFrame:
    """Keep a team-period only if it has an offence and a defence row."""
    return offense.join(defense, list(keys), "inner")


def period_parts(plays: DataFrame) -> DataFrame:
    """Additive parts per (season, week, team, side): what a stream keeps instead of plays."""
    roles = F.array(
        F.struct(F.col("posteam").alias("team"), F.lit(True).alias("__own")),
        F.struct(F.col("defteam").alias("team"), F.lit(False).alias("__own")),
    )
    return (
        scrimmage(plays)
        .filter(F.col("season").isNotNull() & F.col("week").isNotNull())
        .select(*PERIOD, *INPUTS, F.inline(roles))
        .filter(F.col("team").isNotNull())
        .groupBy(*PERIOD, "team", "__own")
        .agg(*[c.alias(n) for n, c in _sums().items()])
    )


def merge_parts(parts: DataFrame) -> DataFrame:
    """Parts of several sets of plays added up."""
    return parts.groupBy(*PERIOD, "team", "__own").agg(*[F.sum(p).alias(p) for p in PARTS])


def stats_from_parts(parts: DataFrame, profile: str = "full") -> DataFrame:
    """Statistics of every (season, week, team) that has both sides, from one row of parts per side."""
    metrics = PROFILES[profile]
    # one row per side: a maximum picks it and keeps the aggregate a hash aggregate
    own = F.col("__own")
    paired = parts.groupBy(*PERIOD, "team").agg(
        F.count("*").alias("__sides"),
        *[F.max(F.when(own, F.col(p))).alias(f"o_{p}") for p in PARTS],
        *[F.max(F.when(~own, F.col(p))).alias(f"d_{p}") for p in PARTS],
    ).filter(F.col("__sides") == 2)
    own, faced = _metrics(lambda p: F.col(f"o_{p}")), _metrics(lambda p: F.col(f"d_{p}"))
    return paired.select(
        *PERIOD,
        "team",
        *[own[m].alias(f"off_{m}") for m in metrics],
        *[faced[m].alias(f"def_{m}") for m in metrics],
    )


def team_period_stats(plays: DataFrame, profile: str = "full") -> DataFrame:
    """Offence and defence statistics for every (season, week, team) that has both."""
    return stats_from_parts(period_parts(plays), profile)


def game_side_summary(plays: DataFrame) -> DataFrame:
    """Per game and side, and below that per play type: plays, EPA sum and mean, success, explosive plays.

    Both levels come from one grouping-sets aggregate; ``level`` tells them apart.
    """
    epa = F.col("epa")
    prepared = scrimmage(plays).filter(F.col("posteam").isNotNull())
    return (
        prepared.groupingSets(
            [["game_id", "posteam"], ["game_id", "posteam", "play_type"]], "game_id", "posteam", "play_type"
        )
        .agg(
            F.when(F.grouping("play_type") == 1, F.lit("side")).otherwise(F.lit("play_type")).alias("level"),
            F.count("*").alias("plays"),
            F.coalesce(F.sum(epa), F.lit(0.0)).alias("epa_sum"),
            F.avg(epa).alias("epa_mean"),
            F.avg(F.col("success").cast("double")).alias("success_rate"),
            F.sum(_true(epa > EXPLOSIVE_EPA)).alias("explosive_plays"),
        )
        .select("game_id", "posteam", "play_type", "level", "plays", "epa_sum", "epa_mean", "success_rate", "explosive_plays")
    )


def team_season_means(
    weekly: DataFrame, offense: str = "off_epa_per_play", defense: str = "def_epa_per_play"
) -> DataFrame:
    """Mean offence and defence value per (team, season) and their margin."""
    return (
        weekly.groupBy("team", "season")
        .agg(F.avg(offense).alias("epa_off"), F.avg(defense).alias("epa_def"))
        .withColumn("epa_margin", F.col("epa_off") - F.col("epa_def"))
    )


def entity_universe(plays: DataFrame, columns: Sequence[str] = ("posteam", "defteam"), name: str = "team") -> DataFrame:
    """Distinct non-NULL values of the listed columns, read in one scan."""
    values = plays.select(F.explode(F.array(*[F.col(c) for c in columns])).alias(name))
    return values.filter(F.col(name).isNotNull()).distinct()


def coverage_summary(df: DataFrame, entity: str = "team", exact: bool = True) -> DataFrame:
    """Season and week range, number of distinct entities and rows."""
    distinct = F.countDistinct(entity) if exact else F.approx_count_distinct(entity)
    return df.agg(
        F.min("season").alias("first_season"),
        F.max("season").alias("last_season"),
        F.min("week").alias("first_week"),
        F.max("week").alias("last_week"),
        distinct.alias("entities"),
        F.count("*").alias("row_count"),
    )
