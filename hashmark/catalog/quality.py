"""Data quality over games, datasets and quotes."""

from __future__ import annotations

from pyspark.sql import functions as F

from hashmark.catalog.bindings import games, sql
from hashmark.catalog.games import keyed
from hashmark.catalog.registry import query
from hashmark.operators import quality, windows
from hashmark.sources import contracts

# A deliberately dirty copy of the games.
_DIRTY_SQL = """(SELECT game_id, CASE WHEN game_id % 101 = 0 THEN away_team ELSE home_team END AS home_team,
  CASE WHEN game_id % 103 = 0 THEN NULL ELSE away_team END AS away_team,
  CASE WHEN game_id % 107 = 0 THEN 55.0::double WHEN game_id % 109 = 0 THEN 'infinity'::double ELSE home_line END AS home_line, rating_home FROM G
  UNION ALL SELECT game_id, home_team, away_team, home_line, rating_home FROM G WHERE game_id % 113 = 0)"""


def dirty(spark, sf_dir):
    g = games(spark, sf_dir).select("game_id", "home_team", "away_team", "home_line", "rating_home")
    spoiled = g.withColumns({
        "home_team": F.when(F.col("game_id") % 101 == 0, F.col("away_team")).otherwise(F.col("home_team")),
        "away_team": F.when(F.col("game_id") % 103 == 0, F.lit(None)).otherwise(F.col("away_team")),
        "home_line": F.when(F.col("game_id") % 107 == 0, F.lit(55.0)).when(F.col("game_id") % 109 == 0, F.lit(float("inf"))).otherwise(F.col("home_line")),
    })
    return spoiled.unionByName(g.filter(F.col("game_id") % 113 == 0))


_RANGE = """SELECT 'home_line' AS "column", count(*) FILTER (abs(home_line) > 40) AS extreme, max(abs(home_line)) AS max_abs, count(*) FILTER (home_line IS NULL) AS nulls,
  count(*) FILTER (isinf(home_line)) AS infinities"""


@query(
    "check_contract",
    sql(
        """SELECT unnest(['non_empty', 'required', 'required', 'required', 'required', 'required', 'required', 'required', 'required', 'numeric', 'numeric', 'numeric', 'numeric', 'numeric']) AS "check",
        unnest(['*', 'game_id', 'season', 'week', 'home_team', 'away_team', 'rating_home', 'rating_away', 'home_line', 'season', 'week', 'rating_home', 'rating_away', 'home_line']) AS "column",
        'error' AS severity,
        unnest([true, true, true, true, true, true, true, false, true, true, true, true, false, true]) AS ok,
        unnest([n, n, n, n, n, n, n, 0, l, n, n, n, 0, l]) AS filled FROM (SELECT count(*) AS n, count(home_line) AS l FROM G)""",
        "G",
    ),
)
def _(spark, sf_dir):
    """The rated-games contract on a frame that lacks the away rating."""
    return quality.check_contract(games(spark, sf_dir).drop("rating_away"), contracts.RATED_GAMES)


@query("range_check", sql(f"{_RANGE} FROM {_DIRTY_SQL}", "G"))
def _(spark, sf_dir):
    return quality.range_check(dirty(spark, sf_dir))


_PROFILED = ("game_id", "home_team", "away_team", "home_line", "rating_home")


@query(
    "null_inf_profile",
    sql(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS nulls, {'count(*) FILTER (isinf(home_line))' if c == 'home_line' else 'CAST(0 AS BIGINT)'} AS infinities FROM {_DIRTY_SQL}"""
            for c in _PROFILED
        ),
        "G",
    ),
)
def _(spark, sf_dir):
    return quality.null_inf_profile(dirty(spark, sf_dir))


_REST = """(SELECT home_team, away_team, coalesce(h, 0) - coalesce(a, 0) AS rest_advantage FROM G JOIN (
  SELECT game_id, max(r) FILTER (is_home) AS h, max(r) FILTER (NOT is_home) AS a FROM (
    SELECT game_id, is_home, date_diff('day', lag(gameday) OVER (PARTITION BY team ORDER BY gameday, game_id), gameday) AS r FROM L) GROUP BY game_id) USING (game_id))"""


def rested(spark, sf_dir):
    g = games(spark, sf_dir).select("game_id", "season", "week", "gameday", "home_team", "away_team")
    return windows.rest_days(g)


@query(
    "rest_anomalies",
    sql(f"""SELECT 'rest_advantage' AS "column", count(*) FILTER (abs(rest_advantage) > 14) AS anomalies, CAST(max(abs(rest_advantage)) AS DOUBLE) AS max_abs FROM {_REST}""", "L"),
)
def _(spark, sf_dir):
    return quality.rest_anomalies(rested(spark, sf_dir))


@query("duplicate_count", sql(f"SELECT 'home_team,away_team' AS keys, CAST(sum(c - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS c FROM {_DIRTY_SQL} GROUP BY home_team, away_team)", "G"))
def _(spark, sf_dir):
    return quality.duplicate_count(dirty(spark, sf_dir), ["home_team", "away_team"])


_PAIRS = "SELECT count(*) FILTER (home_team = away_team) AS self_matchups, count(*) FILTER (home_team IS NULL) AS missing_home, count(*) FILTER (away_team IS NULL) AS missing_away"


@query("pair_consistency", sql(f"{_PAIRS} FROM {_DIRTY_SQL}", "G"))
def _(spark, sf_dir):
    return quality.pair_consistency(dirty(spark, sf_dir))


@query(
    "run_quality_suite",
    sql(
        f""", X AS MATERIALIZED (SELECT * FROM {_DIRTY_SQL}), RC AS ({_RANGE} FROM X), PC AS ({_PAIRS} FROM X), RA AS (SELECT * FROM {_REST})
        SELECT 'extreme_value' AS "check", "column", extreme AS n, max_abs FROM RC
        UNION ALL SELECT 'null_line', "column", nulls, NULL FROM RC UNION ALL SELECT 'infinite_line', "column", infinities, NULL FROM RC
        UNION ALL SELECT 'self_matchup', 'home_team,away_team', self_matchups, NULL FROM PC
        UNION ALL SELECT 'missing_side', 'home_team', missing_home, NULL FROM PC UNION ALL SELECT 'missing_side', 'away_team', missing_away, NULL FROM PC
        UNION ALL SELECT 'duplicate_key', 'game_id', CAST(sum(c - 1) AS BIGINT), NULL FROM (SELECT count(*) AS c FROM X GROUP BY game_id)
        UNION ALL SELECT 'null_feature', c, CAST(0 AS BIGINT), NULL FROM (SELECT unnest(['home_team', 'away_team', 'rest_advantage']) AS c)
        UNION ALL SELECT 'infinite_feature', c, CAST(0 AS BIGINT), NULL FROM (SELECT unnest(['home_team', 'away_team', 'rest_advantage']) AS c)
        UNION ALL SELECT 'rest_anomaly', 'rest_advantage', count(*) FILTER (abs(rest_advantage) > 14), CAST(max(abs(rest_advantage)) AS DOUBLE) FROM RA
        UNION ALL SELECT 'duplicate_pair', 'home_team,away_team', CAST(sum(c - 1) AS BIGINT), NULL FROM (SELECT count(*) AS c FROM RA GROUP BY home_team, away_team)""",
        "L",
    ).replace(") , X AS", "), X AS"),
)
def _(spark, sf_dir):
    features = rested(spark, sf_dir).select("home_team", "away_team", "rest_advantage")
    return quality.run_quality_suite(dirty(spark, sf_dir), features)


@query("enforce_contract", sql("SELECT game_key AS game_id, season, week, home_team, away_team, rating_home, rating_away, home_line FROM K", "K"))
def _(spark, sf_dir):
    """A frame that keeps the contract passes through unchanged."""
    columns = contracts.RATED_GAMES.required
    return quality.enforce_contract(keyed(spark, sf_dir).drop("game_id").withColumnRenamed("game_key", "game_id").select(*columns), contracts.RATED_GAMES)
