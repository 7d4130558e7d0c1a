"""The survey's tables over the given ones.

A binding is one SELECT that Spark and DuckDB both run, so a query and its SQL counterpart start from
the same rows.  Everything above a binding is built with the operators in Spark and by hand in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hashmark.operators.periods import team_period_stats

TEAMS = 32

PLAYS = """
SELECT CAST(year(l_shipdate) AS INTEGER) AS season, CAST(month(l_shipdate) AS INTEGER) AS week,
  concat('T', CAST(l_suppkey % 32 AS STRING)) AS posteam, concat('T', CAST((l_partkey + CASE WHEN l_suppkey % 32 = l_partkey % 32 THEN 1 ELSE 0 END) % 32 AS STRING)) AS defteam,
  l_orderkey AS game_id,
  CASE l_returnflag WHEN 'A' THEN 'pass' WHEN 'R' THEN 'run' ELSE 'no_play' END AS play_type,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE (l_extendedprice - 30000) / 30000 END AS epa,
  CASE WHEN l_extendedprice > 30000 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS success,
  l_linenumber % 4 + 1 AS down,
  CASE WHEN l_linestatus = 'F' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS third_down_converted,
  2 * l_quantity AS yardline_100,
  CASE WHEN l_linestatus = 'O' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS touchdown,
  l_quantity - 10 AS yards_gained,
  CASE WHEN l_tax = 0.08 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS interception,
  CASE WHEN l_discount = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS fumble_lost
FROM {lineitem}
"""

GAMES = """
SELECT o_orderkey AS game_id, CAST(year(o_orderdate) AS INTEGER) AS season, CAST(month(o_orderdate) AS INTEGER) AS week,
  CAST(o_orderdate AS DATE) AS gameday,
  concat('T', CAST(o_custkey % 32 AS STRING)) AS home_team, concat('T', CAST((o_orderkey + CASE WHEN o_custkey % 32 = o_orderkey % 32 THEN 1 ELSE 0 END) % 32 AS STRING)) AS away_team,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) % 45 END AS home_score,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE (o_custkey * 7 + o_orderkey * 3) % 45 END AS away_score,
  CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE (o_orderkey % 29 - 14) / CAST(2 AS DOUBLE) END AS home_line,
  CAST(1300 + (o_custkey * 37) % 400 AS DOUBLE) AS rating_home, CAST(1300 + (o_orderkey * 53) % 400 AS DOUBLE) AS rating_away,
  CAST(nullif(o_orderkey % 5, 0) AS DOUBLE) AS home_bye_mod, CAST(nullif(o_custkey % 4, 0) AS DOUBLE) AS away_bye_mod,
  CAST(nullif(o_orderkey % 2, 0) AS DOUBLE) AS div_game_mod, CAST(o_custkey % 3 - 1 AS DOUBLE) AS dif_surface_mod,
  CAST(nullif(o_orderkey % 3, 0) AS DOUBLE) AS home_time_advantage_mod,
  CAST(o_custkey % 11 - 5 AS DOUBLE) AS home_qb_adj, CAST(nullif(o_orderkey % 13, 6) - 6 AS DOUBLE) AS away_qb_adj,
  CAST(nullif(o_orderkey % 17, 0) AS INTEGER) AS home_rest, CAST(nullif(o_custkey % 19, 0) AS INTEGER) AS away_rest,
  CAST(o_orderkey % 4 = 0 AS INTEGER) AS div_game, CAST(40 + o_orderkey % 15 AS DOUBLE) AS total_line,
  CASE o_orderstatus WHEN 'F' THEN 'REG' WHEN 'O' THEN 'SB' ELSE 'PRE' END AS game_type
FROM {orders}
"""

# Several rows per team on purpose.
SUPPLIER_RATINGS = """
SELECT concat('T', CAST(s_suppkey % 32 AS STRING)) AS team, s_suppkey AS source_id, s_acctbal AS rating FROM {supplier}
"""
CUSTOMER_RATINGS = """
SELECT concat('T', CAST(c_custkey % 32 AS STRING)) AS team, c_custkey AS source_id, c_acctbal AS rating FROM {customer}
"""

QUOTES = """
SELECT event_id, user_id AS game_id, event_type AS book, ts,
  CASE WHEN event_id % 2 = 0 THEN -(100 + value) ELSE 100 + value END AS home_odds,
  CASE WHEN event_id % 2 = 0 THEN 100 + value * 0.9 ELSE -(100 + value * 1.1) END AS away_odds,
  (event_id % 29 - 14) / CAST(2 AS DOUBLE) AS line, event_id % 3 = 0 AS is_home
FROM {events}
"""
KICKOFF = "2024-01-25 00:00:00"

TEXT = {
    "P": (PLAYS, "lineitem"), "G": (GAMES, "orders"), "R": (SUPPLIER_RATINGS, "supplier"),
    "R2": (CUSTOMER_RATINGS, "customer"), "Q": (QUOTES, "events"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, source = TEXT[name]
    return spark.sql(text, **{source: table(spark, sf_dir, source)})


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bind(spark, sf_dir, "P")


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bind(spark, sf_dir, "G")


def supplier_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bind(spark, sf_dir, "R")


def customer_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bind(spark, sf_dir, "R2")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bind(spark, sf_dir, "Q")


def team_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return team_period_stats(plays(spark, sf_dir))


# ---- the SQL side --------------------------------------------------------------------------------

FULL_FLOATS = (
    "epa_total epa_per_play success_rate pass_epa run_epa explosive_rate third_down_conv_rate redzone_td_rate "
    "plays_20plus_rate turnover_rate"
).split()
CORE_FLOATS = "epa_total epa_per_play success_rate pass_epa run_epa".split()


def side_sql(side: str, prefix: str) -> str:
    """Reference aggregate of one side, straight from the definitions."""
    p = prefix
    return f"""
SELECT season, week, {side} AS team, count(*) AS {p}plays, coalesce(sum(epa), 0.0) AS {p}epa_total,
  avg(epa) AS {p}epa_per_play, avg(success) AS {p}success_rate,
  count(*) FILTER (play_type = 'pass') AS {p}pass_plays, avg(epa) FILTER (play_type = 'pass') AS {p}pass_epa,
  count(*) FILTER (play_type = 'run') AS {p}run_plays, avg(epa) FILTER (play_type = 'run') AS {p}run_epa,
  avg(CASE WHEN epa > 0.5 THEN 1 ELSE 0 END) AS {p}explosive_rate,
  count(*) FILTER (down = 3) AS {p}third_down_plays, avg(third_down_converted) FILTER (down = 3) AS {p}third_down_conv_rate,
  count(*) FILTER (yardline_100 <= 20) AS {p}redzone_plays, avg(touchdown) FILTER (yardline_100 <= 20) AS {p}redzone_td_rate,
  count(*) FILTER (yards_gained >= 20) AS {p}plays_20plus_yards,
  avg(CASE WHEN yards_gained >= 20 THEN 1 ELSE 0 END) AS {p}plays_20plus_rate,
  count(*) FILTER (interception = 1) AS {p}interceptions, count(*) FILTER (fumble_lost = 1) AS {p}fumbles_lost,
  avg(CASE WHEN interception = 1 OR fumble_lost = 1 THEN 1 ELSE 0 END) AS {p}turnover_rate
FROM P WHERE play_type IN ('pass', 'run') AND {side} IS NOT NULL GROUP BY season, week, {side}"""


LONG_SQL = """
SELECT game_id, season, week, gameday, home_team AS team, away_team AS opponent, 'home' AS location, true AS is_home,
  home_score AS points_for, away_score AS points_against, CAST(home_score - away_score > 0 AS INTEGER) AS win,
  CAST(home_score - away_score + home_line > 0 AS INTEGER) AS ats_cover, home_score - away_score AS point_diff FROM G
UNION ALL
SELECT game_id, season, week, gameday, away_team, home_team, 'away', false, away_score, home_score,
  CAST(away_score - home_score > 0 AS INTEGER), 1 - CAST(home_score - away_score + home_line > 0 AS INTEGER),
  away_score - home_score FROM G"""

KEYED_SQL = "SELECT *, printf('%d_%02d_%s_%s', season, week, away_team, home_team) AS game_key FROM G"

DATASET_SQL = """
SELECT game_id, season, week, away_team, home_team, rating_home - rating_away AS rating_diff,
  coalesce(home_bye_mod, 0) + coalesce(away_bye_mod, 0) AS rest_advantage, coalesce(div_game_mod, 0) AS div_game,
  coalesce(dif_surface_mod, 0) AS surface_mod, coalesce(home_time_advantage_mod, 0) AS time_advantage,
  coalesce(home_qb_adj, 0) - coalesce(away_qb_adj, 0) AS qb_diff, home_line AS closing_spread,
  CAST(home_score AS DOUBLE) AS home_score, CAST(away_score AS DOUBLE) AS away_score,
  CAST(home_score - away_score AS DOUBLE) AS actual_margin, CAST(home_score AS DOUBLE) AS home_points,
  CAST(away_score AS DOUBLE) AS away_points, CAST(home_score - away_score AS DOUBLE) AS home_margin
FROM G WHERE home_line IS NOT NULL AND rating_home IS NOT NULL AND rating_away IS NOT NULL"""

SCORED_SQL = """
SELECT *, pred - closing_spread AS edge, abs(pred - closing_spread) AS abs_edge,
  CASE WHEN pred - closing_spread < 0 THEN 'home' ELSE 'away' END AS bet_side FROM (
  SELECT *, 'v1.0' AS model, 2.67::double + 0.0447::double * rating_diff AS pred FROM DS
  UNION ALL
  SELECT *, 'v1.2', -1.8373::double - 0.0409::double * rating_diff - 0.0278::double * rest_advantage + 0.0037::double * div_game
    - 0.0098::double * surface_mod - 0.0073::double * time_advantage - 0.0408::double * qb_diff FROM DS)"""

FORM_SQL = """
SELECT team, season, week, avg(off_epa_per_play) OVER w AS offense_form_epa, avg(off_success_rate) OVER w AS offense_form_success,
  avg(def_epa_per_play) OVER w AS defense_form_epa, avg(def_success_rate) OVER w AS defense_form_success
FROM TW WINDOW w AS (PARTITION BY team ORDER BY season, week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)"""


def horner_sql(x: str, coefficients) -> str:
    out = repr(coefficients[0]) + "::double"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::double)"
    return out


def phi_sql(z: str) -> str:
    """Normal distribution function with the same published coefficients."""
    from hashmark.functions.pricing import HART_BOTTOM, HART_TAIL_FROM, HART_TOP, HART_ZERO_FROM, ROOT_TWO_PI

    x = f"abs({z})"
    density = f"exp(-{x} * {x} / 2.0)"
    tail = f"({density} / ({x} + 1.0 / ({x} + 2.0 / ({x} + 3.0 / ({x} + 4.0 / ({x} + 0.65::double))))) / {ROOT_TWO_PI}::double)"
    upper = (
        f"CASE WHEN {x} > {HART_ZERO_FROM} THEN 0.0 WHEN {x} < {HART_TAIL_FROM}::double THEN "
        f"{density} * {horner_sql(x, HART_TOP)} / {horner_sql(x, HART_BOTTOM)} ELSE {tail} END"
    )
    return f"(CASE WHEN {z} > 0 THEN 1.0 - ({upper}) ELSE ({upper}) END)"


# Sized bets of the structural model, with sigma from the test seasons.
SIZED_SQL = f"""
SELECT *, bet_prob * (100.0 / 110.0) * 100.0 - (1 - bet_prob) * 100.0 AS ev_dollars,
  greatest(0.0, ((100.0 / 110.0) * bet_prob - (1 - bet_prob)) / (100.0 / 110.0)) AS kelly_full,
  greatest(0.0, ((100.0 / 110.0) * bet_prob - (1 - bet_prob)) / (100.0 / 110.0)) * 0.25 AS kelly_quarter FROM (
  SELECT *, 1 - home_win_prob AS away_win_prob,
    CASE WHEN bet_side = 'home' THEN home_win_prob ELSE 1 - home_win_prob END AS bet_prob FROM (
    SELECT s.*, CASE WHEN season < 2000 THEN 'train' ELSE 'test' END AS data_split, {phi_sql('(-pred / sigma)')} AS home_win_prob
    FROM SC s, (SELECT stddev_pop(edge) AS sigma FROM SC WHERE model = 'v1.2' AND season >= 2000) WHERE model = 'v1.2'))"""

_CTES = {
    "P": PLAYS.format(lineitem="lineitem"),
    "G": GAMES.format(orders="orders"),
    "R": SUPPLIER_RATINGS.format(supplier="supplier"),
    "R2": CUSTOMER_RATINGS.format(customer="customer"),
    "Q": QUOTES.format(events="events"),
    "O": side_sql("posteam", "off_"),
    "D": side_sql("defteam", "def_"),
    "TW": "SELECT * FROM O JOIN D USING (season, week, team)",
    "FORM": FORM_SQL,
    "L": LONG_SQL,
    "K": KEYED_SQL,
    "DS": DATASET_SQL,
    "SC": SCORED_SQL,
    "SB": SIZED_SQL,
}
_NEEDS = {
    "O": ("P",), "D": ("P",), "TW": ("O", "D"), "FORM": ("TW",), "L": ("G",), "K": ("G",), "DS": ("G",), "SC": ("DS",), "SB": ("SC",),
}


def sql(body: str, *uses: str) -> str:
    """``body`` with the named bindings (and what they need) as common table expressions."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, ()):
            add(n)
        if name not in ordered:
            ordered.append(name)

    for u in uses:
        add(u)
    return "WITH " + ", ".join(f"{n} AS ({_CTES[n]})" for n in ordered) + " " + body if ordered else body
