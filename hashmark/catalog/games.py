"""Game keys, filters, two-sided joins, team-game histories and datasets over the game binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from hashmark.catalog.bindings import (
    customer_ratings, games, plays, sql, supplier_ratings, table, team_week,
)
from hashmark.catalog.registry import query
from hashmark.functions import keys, missing, scoring
from hashmark.operators import joins, periods, reports, reshape, windows
from hashmark.plans import datasets
from hashmark.sources import tables

R_SQL = "(SELECT team, max(rating) AS rating FROM R GROUP BY team)"


def keyed(spark, sf_dir):
    return games(spark, sf_dir).withColumn("game_key", keys.format_game_key())


def team_ratings(spark, sf_dir):
    """One row per team: the supplier with the highest rating."""
    return joins.best_per_key(supplier_ratings(spark, sf_dir), ["team"], "rating", ["source_id"]).select("team", "rating")


# ---- scans and filters ---------------------------------------------------------------------------


@query("select_games", sql("SELECT game_id, season, game_type, home_team AS team_home, away_team AS team_away FROM G WHERE season BETWEEN 1996 AND 1999 AND game_type IN ('REG', 'WC', 'DIV', 'CON', 'SB')", "G"))
def _(spark, sf_dir):
    chosen = tables.select_games(games(spark, sf_dir), 1996, 1999, renames={"home_team": "team_home", "away_team": "team_away"})
    return chosen.select("game_id", "season", "game_type", "team_home", "team_away")


@query("filter_period", sql("SELECT game_id, season, week, home_team, away_team FROM G WHERE season = 1997 AND (home_team = 'T5' OR away_team = 'T5')", "G"))
def _(spark, sf_dir):
    chosen = tables.filter_period(games(spark, sf_dir), 1997, None, "T5", ("home_team", "away_team"))
    return chosen.select("game_id", "season", "week", "home_team", "away_team")


@query("select_rated_games", sql("SELECT game_id, game_key, season, week, away_team, home_team, rating_home, rating_away, home_line FROM K WHERE season BETWEEN 1996 AND 2000 AND home_line IS NOT NULL", "K"))
def _(spark, sf_dir):
    raw = keyed(spark, sf_dir).drop("season", "week", "away_team", "home_team")
    return tables.select_rated_games(raw, 1996, 2000, key="game_key").select(
        "game_id", "game_key", "season", "week", "away_team", "home_team", "rating_home", "rating_away", "home_line"
    )


# ---- keys and text -------------------------------------------------------------------------------


@query("format_game_key", sql("SELECT game_id, game_key FROM K", "K"))
def _(spark, sf_dir):
    return keyed(spark, sf_dir).select("game_id", "game_key")


@query(
    "parse_game_key",
    sql(
        """SELECT game_id, CASE WHEN game_id % 7 = 0 THEN 'no key' ELSE game_key END AS game_key,
        CASE WHEN game_id % 7 <> 0 THEN season END AS season, CASE WHEN game_id % 7 <> 0 THEN week END AS week,
        CASE WHEN game_id % 7 <> 0 THEN away_team END AS away_team, CASE WHEN game_id % 7 <> 0 THEN home_team END AS home_team FROM K""",
        "K",
    ),
)
def _(spark, sf_dir):
    raw = keyed(spark, sf_dir).select(
        "game_id", F.when(F.col("game_id") % 7 == 0, F.lit("no key")).otherwise(F.col("game_key")).alias("game_key")
    )
    return keys.parse_game_key(raw, "game_key")


_MATCHUP = "CASE game_id % 5 WHEN 0 THEN away_team || ' vs ' || home_team WHEN 1 THEN 'bye' ELSE away_team || ' at ' || home_team END"


@query(
    "parse_matchup",
    sql(
        f"""SELECT game_id, {_MATCHUP} AS matchup, CASE WHEN game_id % 5 <> 1 THEN away_team END AS away_team,
        CASE WHEN game_id % 5 <> 1 THEN home_team END AS home_team, CASE WHEN game_id % 5 <> 1 THEN game_id % 5 = 0 END AS is_neutral FROM G""",
        "G",
    ),
)
def _(spark, sf_dir):
    return keys.parse_matchup(games(spark, sf_dir).select("game_id", F.expr(_MATCHUP).alias("matchup")))


_CODES = "concat('A', chr(CAST(65 + game_id % 26 AS INT))) AS home_code, concat('B', chr(CAST(65 + game_id % 26 AS INT))) AS away_code"


@query(
    "parse_quoted_line",
    sql(
        """SELECT game_id, CASE WHEN game_id % 6 = 0 THEN fav || ' PK' WHEN game_id % 6 = 1 THEN 'Pick em' ELSE fav || ' -' || CAST(n AS VARCHAR) END AS favorite_line,
        CASE WHEN game_id % 6 = 1 THEN 'Pick' ELSE fav END AS favorite,
        CASE WHEN game_id % 6 < 2 THEN 0.0 ELSE -n END AS quoted_line,
        CASE WHEN game_id % 6 = 0 THEN 0.0 WHEN game_id % 6 = 1 THEN NULL WHEN game_id % 2 = 0 THEN -n ELSE n END AS home_line FROM (
          SELECT game_id, (game_id % 29) / 2.0::double AS n,
            (CASE WHEN game_id % 2 = 0 THEN 'A' ELSE 'B' END) || chr(CAST(65 + game_id % 26 AS INTEGER)) AS fav FROM G)""",
        "G",
    ),
    "quoted_line home_line",
)
def _(spark, sf_dir):
    raw = games(spark, sf_dir).selectExpr("game_id", "(game_id % 29) / 2.0D AS n", _CODES.split(" AS home_code, ")[0] + " AS home_code", _CODES.split(" AS home_code, ")[1])
    fav = F.when(F.col("game_id") % 2 == 0, F.col("home_code")).otherwise(F.col("away_code"))
    text = (
        F.when(F.col("game_id") % 6 == 0, F.concat(fav, F.lit(" PK")))
        .when(F.col("game_id") % 6 == 1, F.lit("Pick em"))
        .otherwise(F.concat(fav, F.lit(" -"), F.col("n").cast("string")))
    )
    parsed = keys.parse_quoted_line(raw.withColumn("favorite_line", text), home_code="home_code", away_code="away_code", pick_as_zero=True)
    return parsed.select("game_id", "favorite_line", "favorite", "quoted_line", "home_line")


@query("first_listed", "SELECT p_partkey, p_type || ', ' || p_brand AS listed, p_type AS first FROM part")
def _(spark, sf_dir):
    listed = F.concat_ws(", ", "p_type", "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", listed.alias("listed"), keys.first_listed(listed).alias("first"))


_DIRTY = "CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN concat('  ', lower(n_name), ' ') WHEN 2 THEN concat(n_name, '?') END"


@query(
    "normalize_entity",
    f"""SELECT c_custkey, {_DIRTY} AS spelling, CASE WHEN c_custkey % 4 < 2 THEN CAST(n_nationkey AS VARCHAR) END AS code
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def _(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    named = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    dirty = named.select("c_custkey", F.expr(_DIRTY).alias("spelling"))
    aliases = nation.select(F.col("n_name").alias("alias"), F.col("n_nationkey").cast("string").alias("code"))
    return joins.normalize_entity(dirty, "spelling", aliases, "code", "keep")


@query(
    "unknown_entities",
    "SELECT n_name || '?' AS spelling, count(*) AS rows_seen FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 4 = 2 GROUP BY 1",
)
def _(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    named = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    aliases = nation.select(F.col("n_name").alias("alias"), F.col("n_nationkey").cast("string").alias("code"))
    return joins.unknown_entities(named.select(F.expr(_DIRTY).alias("spelling")), "spelling", aliases)


# ---- missing values and expressions --------------------------------------------------------------


@query("require_complete", sql("SELECT game_id, home_line, home_score FROM G WHERE home_line IS NOT NULL AND home_score IS NOT NULL", "G"))
def _(spark, sf_dir):
    return missing.require_complete(games(spark, sf_dir).select("game_id", "home_line", "home_score"), ["home_line", "home_score"])


@query("fill_defaults", sql("SELECT game_id, coalesce(home_rest, 7) AS home_rest, coalesce(home_bye_mod, 0) AS home_bye_mod FROM G", "G"))
def _(spark, sf_dir):
    return missing.fill_defaults(games(spark, sf_dir).select("game_id", "home_rest", "home_bye_mod"), {"home_rest": 7, "home_bye_mod": 0.0})


@query("nan_to_null", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 7 THEN l_extendedprice END AS price FROM lineitem")
def _(spark, sf_dir):
    price = F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(F.col("l_extendedprice"))
    return missing.nan_to_null(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", price.alias("price")))


@query("round_for_report", "SELECT event_id, round_even(value, 1) AS value, CAST(round_even(event_id * 0.25::double, 1) AS DOUBLE) AS quarter FROM events")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value", (F.col("event_id") * 0.25).alias("quarter"))
    return missing.round_for_report(e, ["value", "quarter"], 1)


@query(
    "result_flags",
    sql(
        """SELECT game_id, CAST(m > 0 AS INTEGER) AS home_win, CAST(m < 0 AS INTEGER) AS away_win, m AS point_diff, m + home_line AS home_ats_margin,
        CAST(m + home_line > 0 AS INTEGER) AS home_ats_cover, 1 - CAST(m + home_line > 0 AS INTEGER) AS away_ats_cover
        FROM (SELECT *, home_score - away_score AS m FROM G)""",
        "G",
    ),
)
def _(spark, sf_dir):
    return scoring.result_flags(games(spark, sf_dir)).select(
        "game_id", "home_win", "away_win", "point_diff", "home_ats_margin", "home_ats_cover", "away_ats_cover"
    )


@query("side_differences", sql("SELECT game_id, rating_home - rating_away AS rating_diff, home_qb_adj - away_qb_adj AS qb_diff, home_score - away_score AS actual_margin FROM G", "G"))
def _(spark, sf_dir):
    pairs = {"rating_diff": ("rating_home", "rating_away"), "qb_diff": ("home_qb_adj", "away_qb_adj"), "actual_margin": ("home_score", "away_score")}
    return scoring.side_differences(games(spark, sf_dir), pairs).select("game_id", *pairs)


@query("rest_from_modifiers", sql("SELECT game_id, coalesce(home_bye_mod, 0) + coalesce(away_bye_mod, 0) AS rest_advantage FROM G", "G"))
def _(spark, sf_dir):
    return scoring.rest_from_modifiers(games(spark, sf_dir)).select("game_id", "rest_advantage")


_REST_SQL = """CASE WHEN home_rest IS NULL OR away_rest IS NULL THEN 0.0 ELSE
  (CASE WHEN home_rest >= 14 AND away_rest < 14 THEN 0.05 WHEN away_rest >= 14 AND home_rest < 14 THEN -0.05 ELSE 0.0 END)
  + (CASE WHEN home_rest < 7 AND away_rest >= 7 THEN -0.125 WHEN away_rest < 7 AND home_rest >= 7 THEN 0.125 ELSE 0.0 END) END"""


@query(
    "rest_situation",
    sql(f"SELECT game_id, CAST(coalesce(home_rest >= 14, false) AS INTEGER) - CAST(coalesce(away_rest >= 14, false) AS INTEGER) AS bye_diff, CAST({_REST_SQL} AS DOUBLE) AS rest_adj FROM G", "G"),
    "rest_adj",
)
def _(spark, sf_dir):
    return scoring.rest_situation(games(spark, sf_dir)).select("game_id", "bye_diff", "rest_adj")


@query(
    "situational_spread",
    sql(
        f"""SELECT game_id, base_spread, rest_adj, div_adj, base_spread + rest_adj + div_adj AS predicted_spread FROM (
        SELECT game_id, 2.67::double + 0.0447::double * (rating_home - rating_away) AS base_spread, CAST({_REST_SQL} AS DOUBLE) AS rest_adj,
          CASE WHEN div_game = 1 THEN -0.415::double ELSE 0.0::double END AS div_adj FROM G)""",
        "G",
    ),
    "base_spread rest_adj div_adj predicted_spread",
)
def _(spark, sf_dir):
    g = scoring.side_differences(games(spark, sf_dir), {"rating_diff": ("rating_home", "rating_away")})
    return scoring.situational_spread(g).select("game_id", "base_spread", "rest_adj", "div_adj", "predicted_spread")


_FORM_ADJ = "CASE WHEN {w} >= 4 THEN {hot} WHEN {w} <= 1 THEN {cold} ELSE 0.0::double END"
_LAST5 = "sum(win) OVER (PARTITION BY team ORDER BY season, week, gameday, game_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"


@query(
    "hot_cold_adjustment",
    sql(
        f"""SELECT game_id, h AS home_form_adj, a AS away_form_adj, h + a AS form_adj FROM (
        SELECT game_id, {_FORM_ADJ.format(w='hw', hot='-0.5::double', cold='0.5::double')} AS h, {_FORM_ADJ.format(w='aw', hot='0.5::double', cold='-0.5::double')} AS a FROM (
          SELECT game_id, max(w5) FILTER (is_home) AS hw, max(w5) FILTER (NOT is_home) AS aw FROM (SELECT game_id, is_home, {_LAST5} AS w5 FROM L) GROUP BY game_id))""",
        "L",
    ),
    "home_form_adj away_form_adj form_adj",
)
def _(spark, sf_dir):
    form = windows.recent_form(games(spark, sf_dir))
    wins = form.groupBy("game_id").agg(
        F.max(F.when(F.col("is_home"), F.col("last_5_wins"))).alias("home_wins"),
        F.max(F.when(~F.col("is_home"), F.col("last_5_wins"))).alias("away_wins"),
    )
    return scoring.hot_cold_adjustment(wins, "home_wins", "away_wins").drop("home_wins", "away_wins")


@query("flip_perspective", sql("SELECT game_id, -home_line + 0.0 AS home_line FROM G", "G"), "home_line")
def _(spark, sf_dir):
    return games(spark, sf_dir).select("game_id", scoring.flip_perspective(F.col("home_line")).alias("home_line"))


# ---- joins ---------------------------------------------------------------------------------------


@query("best_per_key", sql("SELECT team, max(rating) AS rating, max_by(source_id, rating) AS source_id FROM R GROUP BY team", "R"))
def _(spark, sf_dir):
    return joins.best_per_key(supplier_ratings(spark, sf_dir), ["team"], "rating", ["source_id"])


@query(
    "join_cardinality",
    sql(
        """SELECT CAST(sum(c) AS BIGINT) AS row_count, count(*) AS distinct_keys, count(*) FILTER (c > 1) AS repeated_keys, max(c) AS largest
        FROM (SELECT team, count(*) AS c FROM R GROUP BY team)""",
        "R",
    ),
)
def _(spark, sf_dir):
    return joins.join_cardinality(supplier_ratings(spark, sf_dir), ["team"])


@query(
    "join_both_sides",
    sql(
        f"""SELECT game_id, home_team, away_team, h.rating AS rating_home, h.rating * 2 AS doubled_home, a.rating AS rating_away, a.rating * 2 AS doubled_away
        FROM G LEFT JOIN {R_SQL} h ON home_team = h.team LEFT JOIN {R_SQL} a ON away_team = a.team""",
        "G", "R",
    ),
    "rating_home doubled_home rating_away doubled_away",
)
def _(spark, sf_dir):
    ratings = team_ratings(spark, sf_dir).withColumn("doubled", F.col("rating") * 2)
    return joins.join_both_sides(games(spark, sf_dir).select("game_id", "home_team", "away_team"), ratings)


@query(
    "matchup_features",
    sql(
        """SELECT game_id, h.epa_off - a.epa_def AS home_off_vs_away_def, a.epa_off - h.epa_def AS away_off_vs_home_def FROM G
        LEFT JOIN (SELECT team, avg(off_epa_per_play) AS epa_off, avg(def_epa_per_play) AS epa_def FROM TW GROUP BY team) h ON h.team = home_team
        LEFT JOIN (SELECT team, avg(off_epa_per_play) AS epa_off, avg(def_epa_per_play) AS epa_def FROM TW GROUP BY team) a ON a.team = away_team""",
        "G", "TW",
    ),
    "home_off_vs_away_def away_off_vs_home_def",
)
def _(spark, sf_dir):
    ratings = team_week(spark, sf_dir).groupBy("team").agg(F.avg("off_epa_per_play").alias("epa_off"), F.avg("def_epa_per_play").alias("epa_def"))
    out = joins.matchup_features(games(spark, sf_dir), ratings)
    return out.select("game_id", "home_off_vs_away_def", "away_off_vs_home_def")


_FORM_NAMES = ("offense_form_epa", "offense_form_success", "defense_form_epa", "defense_form_success")
_FORM_DIFFS = ", ".join(f"h.{c} - a.{c} AS {c}_diff" for c in _FORM_NAMES)
_FORM_JOIN = """LEFT JOIN FORM h ON h.team = home_team AND h.season = g.season AND h.week = g.week
  LEFT JOIN FORM a ON a.team = away_team AND a.season = g.season AND a.week = g.week"""


@query("join_form_both_sides", sql(f"SELECT game_id, {_FORM_DIFFS} FROM G g {_FORM_JOIN}", "G", "FORM"), " ".join(f"{c}_diff" for c in _FORM_NAMES))
def _(spark, sf_dir):
    form = windows.team_form(team_week(spark, sf_dir))
    g = games(spark, sf_dir).select("game_id", "season", "week", "home_team", "away_team")
    return joins.join_form_both_sides(g, form).select("game_id", *[f"{c}_diff" for c in _FORM_NAMES])


@query(
    "missing_feature_count",
    sql(
        f"""SELECT count(*) AS row_count, count(*) FILTER ({' OR '.join(f'{c}_diff IS NULL' for c in _FORM_NAMES)}) AS rows_missing
        FROM (SELECT {_FORM_DIFFS} FROM G g {_FORM_JOIN})""",
        "G", "FORM",
    ),
)
def _(spark, sf_dir):
    form = windows.team_form(team_week(spark, sf_dir))
    g = games(spark, sf_dir).select("game_id", "season", "week", "home_team", "away_team")
    return reports.missing_feature_count(joins.join_form_both_sides(g, form), [f"{c}_diff" for c in _FORM_NAMES])


@query(
    "merge_ratings",
    sql(
        f"""SELECT b.team, b.rating, c.rating AS rating_customer, c.accounts FROM {R_SQL} b
        LEFT JOIN (SELECT team, avg(rating) AS rating, count(*) AS accounts FROM R2 GROUP BY team) c USING (team)""",
        "R", "R2",
    ),
    "rating rating_customer",
)
def _(spark, sf_dir):
    other = customer_ratings(spark, sf_dir).groupBy("team").agg(F.avg("rating").alias("rating"), F.count("*").alias("accounts"))
    merged, _ = joins.merge_ratings(team_ratings(spark, sf_dir), [("customer", other), ("absent", None)])
    return merged


@query("merge_audit", sql("SELECT DISTINCT home_team AS team FROM G WHERE home_team NOT IN (SELECT team FROM R WHERE rating > 2000)", "G", "R"))
def _(spark, sf_dir):
    base = supplier_ratings(spark, sf_dir).filter("rating > 2000")
    return joins.merge_audit(base, games(spark, sf_dir).select(F.col("home_team").alias("team")))


@query(
    "attach_weekly_stats",
    sql("SELECT game_id, team, is_home, off_epa_per_play, def_epa_per_play FROM L LEFT JOIN TW USING (season, week, team)", "L", "TW"),
    "off_epa_per_play def_epa_per_play",
)
def _(spark, sf_dir):
    stats = team_week(spark, sf_dir).select("season", "week", "team", "off_epa_per_play", "def_epa_per_play")
    out = joins.attach_weekly_stats(reshape.to_team_games(games(spark, sf_dir)), stats)
    return out.select("game_id", "team", "is_home", "off_epa_per_play", "def_epa_per_play")


_SEASON_MEANS = "(SELECT team, season, avg(off_epa_per_play) - avg(def_epa_per_play) AS epa_margin FROM TW GROUP BY team, season)"


@query(
    "attach_season_means",
    sql(
        f"""SELECT game_id, h.epa_margin AS epa_margin_home, a.epa_margin AS epa_margin_away, h.epa_margin - a.epa_margin AS epa_margin_diff FROM G g
        JOIN {_SEASON_MEANS} h ON h.team = home_team AND h.season = g.season JOIN {_SEASON_MEANS} a ON a.team = away_team AND a.season = g.season""",
        "G", "TW",
    ),
    "epa_margin_home epa_margin_away epa_margin_diff",
)
def _(spark, sf_dir):
    means = periods.team_season_means(team_week(spark, sf_dir))
    out = joins.attach_season_means(games(spark, sf_dir).select("game_id", "season", "home_team", "away_team"), means)
    return out.select("game_id", "epa_margin_home", "epa_margin_away", "epa_margin_diff")


# ---- long tables and windows ---------------------------------------------------------------------


@query("to_team_games", sql("SELECT * FROM L", "L"))
def _(spark, sf_dir):
    return reshape.to_team_games(games(spark, sf_dir))


@query("game_ratings_to_team", sql(
    """SELECT team, arg_min(rating, (season, week, gameday, game_id, side)) AS rating FROM (
    SELECT season, week, gameday, game_id, 0 AS side, home_team AS team, rating_home AS rating FROM G UNION ALL
    SELECT season, week, gameday, game_id, 1, away_team, rating_away FROM G) GROUP BY team""", "G"))
def _(spark, sf_dir):
    return reshape.game_ratings_to_team(games(spark, sf_dir))


@query("key_difference", sql("SELECT home_team, season FROM G EXCEPT SELECT posteam, season FROM P WHERE season < 1999 AND epa > 2", "G", "P"))
def _(spark, sf_dir):
    b = plays(spark, sf_dir).filter("season < 1999 AND epa > 2").select(F.col("posteam").alias("home_team"), "season")
    return reshape.key_difference(games(spark, sf_dir), b, ["home_team", "season"])


@query("matchups_from_games", sql("SELECT season, week, away_team, home_team, home_line AS closing_line FROM G", "G"))
def _(spark, sf_dir):
    return reshape.matchups_from_games(games(spark, sf_dir))


def _recent_sql(n: int) -> str:
    w = f"OVER (PARTITION BY team ORDER BY season, week, gameday, game_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"avg(win) {w} AS win_rate_L{n}, avg(ats_cover) {w} AS ats_rate_L{n}, avg(point_diff) {w} AS point_diff_L{n}"


_RECENT = [f"{c}_L{n}" for n in (3, 5) for c in ("win_rate", "ats_rate", "point_diff")]


@query("recent_form", sql(f"SELECT game_id, team, CAST({_LAST5} AS BIGINT) AS last_5_wins, {_recent_sql(3)}, {_recent_sql(5)} FROM L", "L"), " ".join(_RECENT))
def _(spark, sf_dir):
    return windows.recent_form(games(spark, sf_dir)).select("game_id", "team", "last_5_wins", *_RECENT)


_TEAM_REST = "CAST(date_diff('day', lag(gameday) OVER (PARTITION BY team ORDER BY gameday, game_id), gameday) AS INTEGER)"


@query("team_rest", sql(f"SELECT game_id, team, is_home, {_TEAM_REST} AS rest_days FROM L", "L"))
def _(spark, sf_dir):
    return windows.team_rest(games(spark, sf_dir)).select("game_id", "team", "is_home", "rest_days")


_RESTS = f"(SELECT game_id, max(r) FILTER (is_home) AS home_rest_days, max(r) FILTER (NOT is_home) AS away_rest_days FROM (SELECT game_id, is_home, {_TEAM_REST} AS r FROM L) GROUP BY game_id)"


@query(
    "rest_days",
    sql(f"SELECT game_id, season, home_team, away_team, home_rest_days, away_rest_days, coalesce(home_rest_days, 0) - coalesce(away_rest_days, 0) AS rest_advantage FROM G JOIN {_RESTS} USING (game_id)", "L"),
)
def _(spark, sf_dir):
    g = games(spark, sf_dir).select("game_id", "season", "week", "gameday", "home_team", "away_team")
    return windows.rest_days(g).drop("week", "gameday")


@query(
    "entity_record",
    sql(
        """SELECT team, count(*) AS games_played, count(*) FILTER (points_for > points_against) AS wins, count(*) FILTER (points_for < points_against) AS losses,
        count(*) FILTER (points_for = points_against) AS ties, avg(points_for) AS ppg, avg(points_against) AS ppg_allowed, avg(point_diff) AS margin
        FROM L WHERE season = 1998 AND week <= 6 AND points_for IS NOT NULL AND points_against IS NOT NULL GROUP BY team""",
        "L",
    ),
    "ppg ppg_allowed margin",
)
def _(spark, sf_dir):
    return windows.entity_record(reshape.to_team_games(games(spark, sf_dir)), 1998, 6)


@query(
    "last_n_summary",
    sql(
        """SELECT team, CAST(sum(win) AS BIGINT) AS last_5_wins, avg(point_diff) AS last_5_margin FROM (
        SELECT *, row_number() OVER (PARTITION BY team ORDER BY season DESC, week DESC, gameday DESC, game_id DESC) AS r FROM L
        WHERE points_for IS NOT NULL AND points_against IS NOT NULL) WHERE r <= 5 GROUP BY team""",
        "L",
    ),
    "last_5_margin",
)
def _(spark, sf_dir):
    return windows.last_n_summary(reshape.to_team_games(games(spark, sf_dir)))


_H2H = """(SELECT *, least(home_team, away_team) AS side_a, greatest(home_team, away_team) AS side_b,
  CAST(row_number() OVER (PARTITION BY least(home_team, away_team), greatest(home_team, away_team) ORDER BY gameday DESC, game_id DESC) AS INTEGER) AS meeting FROM G)"""


@query("head_to_head", sql(f"SELECT game_id, side_a, side_b, meeting, season, week, home_score, away_score, home_line FROM {_H2H} WHERE meeting <= 10", "G"))
def _(spark, sf_dir):
    return windows.head_to_head(games(spark, sf_dir)).select(
        "game_id", "side_a", "side_b", "meeting", "season", "week", "home_score", "away_score", "home_line"
    )


@query(
    "head_to_head_summary",
    sql(
        f"""SELECT side_a, side_b, count(*) AS meetings,
        count(*) FILTER ((home_team = side_a AND home_score > away_score) OR (away_team = side_a AND away_score > home_score)) AS side_a_wins,
        count(*) FILTER ((home_team = side_b AND home_score > away_score) OR (away_team = side_b AND away_score > home_score)) AS side_b_wins,
        avg(home_score + away_score) AS mean_total FROM {_H2H} WHERE meeting <= 5 GROUP BY side_a, side_b""",
        "G",
    ),
    "mean_total",
)
def _(spark, sf_dir):
    return windows.head_to_head_summary(games(spark, sf_dir), 5)


_EPA_ROLL = ", ".join(
    f"avg({src}) OVER (PARTITION BY team ORDER BY season, week, gameday, game_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS {name}_L{n}"
    for n in (3, 5, 10) for name, src in (("epa_off", "off_epa_per_play"), ("epa_def", "def_epa_per_play"))
)
_FRAME_FEATURES = ["rest_days", "last_5_wins", *_RECENT, *[f"{c}_L{n}" for n in (3, 5, 10) for c in ("epa_off", "epa_def")]]
_FRAME_REST = "CAST(date_diff('day', lag(gameday) OVER (PARTITION BY team ORDER BY season, week, gameday, game_id), gameday) AS INTEGER)"


@query(
    "team_feature_frame",
    sql(
        f"""SELECT *, coalesce(rest_days_home, 0) - coalesce(rest_days_away, 0) AS rest_advantage FROM (
        SELECT game_id, {', '.join(f'max({f}) FILTER (is_home) AS {f}_home, max({f}) FILTER (NOT is_home) AS {f}_away' for f in _FRAME_FEATURES)} FROM (
          SELECT game_id, is_home, {_FRAME_REST} AS rest_days, CAST({_LAST5} AS BIGINT) AS last_5_wins, {_recent_sql(3)}, {_recent_sql(5)}, {_EPA_ROLL}
          FROM L LEFT JOIN TW USING (season, week, team)) GROUP BY game_id)""",
        "L", "TW",
    ),
    " ".join(f"{f}_{s}" for f in _FRAME_FEATURES[2:] for s in ("home", "away")),
)
def _(spark, sf_dir):
    g = games(spark, sf_dir).select("game_id", "season", "week", "gameday", "home_team", "away_team", "home_score", "away_score", "home_line")
    frame = datasets.team_feature_frame(g, team_week(spark, sf_dir))
    return frame.select("game_id", *[f"{f}_{s}" for f in _FRAME_FEATURES for s in ("home", "away")], "rest_advantage")


@query(
    "next_period",
    sql("SELECT season, week FROM G WHERE gameday >= DATE '1999-05-17' ORDER BY gameday, game_id LIMIT 1", "G"),
)
def _(spark, sf_dir):
    return reports.next_period(games(spark, sf_dir), "1999-05-17")


@query("week_lines", sql("SELECT game_id, gameday, away_team, home_team, home_line, total_line FROM G WHERE season = 1998 AND week = 7", "G"))
def _(spark, sf_dir):
    return reports.week_lines(games(spark, sf_dir), 1998, 7, ["home_line", "total_line"])


@query("line_availability", sql("SELECT season, week, count(*) AS games, count(home_line) AS games_with_line FROM G GROUP BY season, week", "G"))
def _(spark, sf_dir):
    return reports.line_availability(games(spark, sf_dir))


# ---- datasets ------------------------------------------------------------------------------------


@query(
    "base_dataset",
    sql("SELECT game_id, season, week, away_team, home_team, rating_diff, closing_spread, home_score, away_score, actual_margin, home_points, away_points, home_margin FROM DS", "DS"),
)
def _(spark, sf_dir):
    return datasets.base_dataset(keyed(spark, sf_dir), key="game_key")


@query("structural_dataset", sql("SELECT * FROM DS", "DS"))
def _(spark, sf_dir):
    return datasets.structural_dataset(keyed(spark, sf_dir), key="game_key")


@query(
    "form_dataset",
    sql(f"SELECT g.*, {_FORM_DIFFS} FROM DS g {_FORM_JOIN}", "DS", "FORM"),
    " ".join(f"{c}_diff" for c in _FORM_NAMES),
)
def _(spark, sf_dir):
    return datasets.form_dataset(keyed(spark, sf_dir), team_week(spark, sf_dir), key="game_key")


@query(
    "columns_by_family",
    sql("SELECT game_id, rest_advantage, qb_diff FROM DS", "DS"),
)
def _(spark, sf_dir):
    from hashmark.operators.families import columns_by_family

    dataset = datasets.structural_dataset(keyed(spark, sf_dir), key="game_key")
    return columns_by_family(dataset, keep=["game_id"])


@query(
    "family_report",
    sql(
        """SELECT unnest(['rest', 'passer', 'rating', 'any difference', 'any difference']) AS family, unnest(['rest_advantage', 'qb_diff', 'rating_diff', 'rating_diff', 'qb_diff']) AS "column",
        'double' AS type, unnest([r, q, d, d, q]) AS filled FROM (SELECT count(rest_advantage) AS r, count(qb_diff) AS q, count(rating_diff) AS d FROM DS)""",
        "DS",
    ),
)
def _(spark, sf_dir):
    from hashmark.operators.families import family_report

    dataset = datasets.structural_dataset(keyed(spark, sf_dir), key="game_key")
    return family_report(dataset, {"rest": ["rest_"], "passer": ["qb_"], "rating": ["rating_"], "any difference": ["_diff"], "coach": ["coach_"]})
