"""Scans and sinks: tables and snapshot files are written from the given tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from hashmark.catalog.bindings import customer_ratings, games, plays, sql, supplier_ratings, table, team_week
from hashmark.catalog.games import keyed, team_ratings
from hashmark.catalog.registry import query
from hashmark.catalog.reports import dataset, sized
from hashmark.operators import quality
from hashmark.plans import evaluation
from hashmark.session import scratch_path
from hashmark.sources import sinks, snapshots, tables

_PLAY_COLUMNS = "season, week, posteam, defteam, play_type, epa, success, down, third_down_converted, yardline_100, touchdown, yards_gained, interception, fumble_lost"


@query("scan_plays", sql(f"SELECT {_PLAY_COLUMNS}, game_id FROM P", "P"), "epa")
def _(spark, sf_dir):
    """Plays with missing EPA stored as NaN, written as Parquet by season, then scanned."""
    path = scratch_path(spark, "plays") + ".parquet"
    spoiled = plays(spark, sf_dir).withColumn("epa", F.coalesce("epa", F.lit(float("nan"))))
    sinks.repack_plays(spoiled, path)
    return tables.scan_plays(spark, path)


@query("scan_plays_csv", sql("SELECT season, week, posteam, count(*) AS plays, count(epa) AS known, sum(epa) AS epa, CAST(sum(down) AS BIGINT) AS downs FROM P GROUP BY season, week, posteam", "P"), "epa", 4)
def _(spark, sf_dir):
    path = scratch_path(spark, "plays") + ".csv"
    plays(spark, sf_dir).write.option("header", True).csv(path)
    scanned = tables.scan_plays(spark, path)
    return scanned.groupBy("season", "week", "posteam").agg(
        F.count("*").alias("plays"), F.count("epa").alias("known"), F.sum("epa").alias("epa"), F.sum("down").alias("downs")
    )


@query("scan_games", sql("SELECT game_id, season, week, gameday, home_team, away_team FROM G WHERE season BETWEEN 1997 AND 1999 AND game_type IN ('REG', 'SB')", "G"))
def _(spark, sf_dir):
    path = scratch_path(spark, "games")
    games(spark, sf_dir).write.partitionBy("season").parquet(path)
    return tables.scan_games(spark, path, start=1997, end=1999).select("game_id", "season", "week", "gameday", "home_team", "away_team")


@query(
    "scan_team_week",
    sql("SELECT season, week, 'team ' || team AS team, off_epa_per_play, def_epa_per_play FROM TW WHERE season BETWEEN 1996 AND 1998", "TW"),
    "off_epa_per_play def_epa_per_play",
)
def _(spark, sf_dir):
    """Written with the older defence name and read back in canonical names, teams through an alias table."""
    path = scratch_path(spark, "team-week")
    tw = team_week(spark, sf_dir).select("season", "week", "team", "off_epa_per_play", "def_epa_per_play")
    sinks.write_team_week(tw.withColumnRenamed("def_epa_per_play", "def_epa_allowed_per_play"), path)
    aliases = team_ratings(spark, sf_dir).select(F.col("team").alias("alias"), F.concat(F.lit("team "), "team").alias("code"))
    return tables.scan_team_week(spark, path, 1996, 1998, aliases)


@query("write_team_week", sql("SELECT season, week, team, CASE WHEN season = 1998 THEN 0 ELSE off_plays END AS off_plays FROM TW", "TW"))
def _(spark, sf_dir):
    """A rewrite of one season replaces that season only."""
    path = scratch_path(spark, "team-week")
    tw = team_week(spark, sf_dir).select("season", "week", "team", "off_plays")
    sinks.write_team_week(tw, path)
    sinks.write_team_week(tw.filter(F.col("season") == 1998).withColumn("off_plays", F.lit(0).cast("long")), path)
    return tables.read_table(spark, path)


@query("write_predictions", sql("SELECT game_id, model, season, week, pred, edge FROM SC", "SC"), "pred edge")
def _(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    sinks.write_predictions(evaluation.score_games(dataset(spark, sf_dir)).select("game_id", "model", "season", "week", "pred", "edge"), path)
    return tables.read_table(spark, path)


@query(
    "write_backtest",
    sql("SELECT model, season, count(*) AS n_games, avg(abs_edge) AS mae_vs_market FROM SC GROUP BY model, season", "SC"),
    "mae_vs_market",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "backtest")
    sinks.write_backtest(evaluation.backtest(dataset(spark, sf_dir)), path)
    return tables.read_table(spark, path).select("model", "season", "n_games", "mae_vs_market")


@query(
    "scan_rated_games",
    sql("SELECT game_id, game_key, season, week, away_team, home_team, rating_home, rating_away, home_line FROM K WHERE season BETWEEN 1996 AND 2000 AND home_line IS NOT NULL", "K"),
)
def _(spark, sf_dir):
    """The same from a table: the presence terms are pushed into its scan."""
    path = scratch_path(spark, "rated")
    keyed(spark, sf_dir).drop("season", "week", "away_team", "home_team").write.parquet(path)
    return tables.scan_rated_games(spark, path, start=1996, end=2000, key="game_key").select(
        "game_id", "game_key", "season", "week", "away_team", "home_team", "rating_home", "rating_away", "home_line"
    )


@query("write_comparison", sql("SELECT model, count(*) AS total_games FROM SC GROUP BY model", "SC"))
def _(spark, sf_dir):
    path = scratch_path(spark, "comparison")
    sinks.write_comparison(evaluation.compare(dataset(spark, sf_dir)), path)
    return tables.read_table(spark, path).select("model", "total_games")


@query("write_detailed", sql("SELECT game_id, season, week, away_team, home_team, pred, edge, abs_edge, home_win_prob, ev_dollars, kelly_quarter, bet_side FROM SB", "SB"), "pred edge abs_edge home_win_prob ev_dollars kelly_quarter")
def _(spark, sf_dir):
    path = scratch_path(spark, "detailed")
    sinks.write_detailed(sized(spark, sf_dir), path)
    return tables.read_table(spark, path)


@query("repack_plays", sql("SELECT season, count(*) AS plays, count(epa) AS known FROM P GROUP BY season", "P"))
def _(spark, sf_dir):
    path = scratch_path(spark, "plays")
    sinks.repack_plays(plays(spark, sf_dir), path)
    return tables.read_table(spark, path).groupBy("season").agg(F.count("*").alias("plays"), F.count("epa").alias("known"))


# ---- provider snapshots --------------------------------------------------------------------------

_R = "(SELECT 'T' || CAST(s_suppkey % 32 AS VARCHAR) AS team, max(s_acctbal) AS a, avg(s_acctbal) AS b, count(*) AS n FROM supplier GROUP BY 1)"
_C = "(SELECT 'T' || CAST(c_custkey % 32 AS VARCHAR) AS team, max(c_acctbal) AS a, avg(c_acctbal) AS b, count(*) AS n FROM customer GROUP BY 1)"


def _per_team(rows):
    return rows.groupBy("team").agg(F.max("rating").alias("a"), F.avg("rating").alias("b"), F.count("*").alias("n"))


def _write_csv(df, folder: str, name: str, preamble: list[str] | None = None) -> None:
    """One snapshot of 32 teams; with a preamble, as text lines with a mark and a line above the header."""
    one = df.coalesce(1)
    if preamble is None:
        one.write.option("header", True).csv(f"{folder}/{name}")
        return
    spark = df.sparkSession
    head = spark.createDataFrame([("﻿" + ",".join(preamble),), (",".join(df.columns),)], "value string")
    body = one.select(F.concat_ws(",", *[F.col(f"`{c}`").cast("string") for c in df.columns]).alias("value"))
    head.coalesce(1).union(body).coalesce(1).write.text(f"{folder}/{name}")


def snapshot_folder(spark, sf_dir, *categories: str) -> str:
    """Files of two providers and three weeks: category-first, legacy, with a preamble, with extra columns."""
    folder = scratch_path(spark, "snapshots")
    for category in categories:
        WRITERS[category](spark, sf_dir, folder)
    return folder


def _write_power_ratings(spark, sf_dir, folder: str) -> None:
    s, c = _per_team(supplier_ratings(spark, sf_dir)), _per_team(customer_ratings(spark, sf_dir))
    first = s.select(F.col("team").alias("Team"), F.lit(2025).alias("Season"), F.col("a").alias("rating"), F.col("b").alias("QB Adj"), F.col("n").alias("Value"))
    _write_csv(first, folder, "power_ratings_alpha_2025_week_1.csv")
    _write_csv(first.withColumn("rating", F.col("rating") - 5000), folder, "alpha_power_ratings_2025_week_1.csv")
    _write_csv(first.withColumn("rating", F.col("rating") + 1), folder, "alpha_power_ratings_2025_week_2.csv")
    second = c.select(F.col("team").alias("Team"), F.lit("East").alias("Div."), F.col("a").alias("Off."), F.col("b").alias("Def."), F.col("n").alias("Ovr."))
    _write_csv(second, folder, "power_ratings_beta_2025_week_1.csv", ["X.1", "X.2", "~~~Ratings~~~", "X.3", "X.4"])


def _write_epa_tiers(spark, sf_dir, folder: str) -> None:
    s = _per_team(supplier_ratings(spark, sf_dir))
    tiers = s.select(F.col("team").alias("Team"), F.lit(2025).alias("Season"), F.col("a").alias("EPA/Play"), F.col("b").alias("EPA/Play Against"))
    _write_csv(tiers, folder, "epa_tiers_alpha_2025_week_1.csv")


def _write_strength(spark, sf_dir, folder: str) -> None:
    s = _per_team(supplier_ratings(spark, sf_dir))
    strength = s.select(F.col("team").alias("Team"), F.col("a").alias("Original Rating"), F.col("b").alias("Avg. Opp. Rating"), F.col("n").alias("Rank"))
    _write_csv(strength, folder, "strength_of_schedule_alpha_2025_week_1.csv")


def _write_passers(spark, sf_dir, folder: str) -> None:
    passers = customer_ratings(spark, sf_dir).select(
        F.concat(F.lit("Player "), F.col("source_id")).alias("Player"), F.concat(F.lower("team"), F.lit(", zzz")).alias("Tms"),
        (F.col("source_id") % 500).alias("Plays"), F.col("rating").alias("EPA"),
    )
    passers.write.option("header", True).csv(f"{folder}/qb_epa_beta_2025_week_1.csv")


def _write_projections(spark, sf_dir, folder: str) -> None:
    pairs = games(spark, sf_dir).select(
        F.col("gameday").alias("Date"), F.concat_ws(" at ", "away_team", "home_team").alias("Matchup"),
        F.concat(F.lit("T -"), F.col("game_id") % 15).alias("Favorite"), (F.col("game_id") % 100).alias("Win Prob."),
    )
    pairs.write.option("header", True).csv(f"{folder}/beta_weekly_proj_ppg_2025_week_1.csv")


WRITERS = {
    "power_ratings": _write_power_ratings, "epa_tiers": _write_epa_tiers, "strength_of_schedule": _write_strength,
    "qb_epa": _write_passers, "weekly_projections_ppg": _write_projections,
}


@query(
    "scan_provider_snapshots",
    f"""SELECT 'power_ratings' AS category, 'alpha' AS provider, CAST(2025 AS INTEGER) AS season, CAST(week AS INTEGER) AS week, week = 2 AS legacy, team, a + week - 1 AS rating, b AS qb_adj,
      CAST(n AS DOUBLE) AS value, NULL::double AS off_rating, NULL::double AS def_rating, NULL::double AS overall FROM {_R}, (SELECT unnest([1, 2]) AS week)
    UNION ALL SELECT 'power_ratings', 'beta', 2025, 1, false, team, NULL, NULL, NULL, a, b, CAST(n AS DOUBLE) FROM {_C}""",
    "rating qb_adj value off_rating def_rating overall",
)
def _(spark, sf_dir):
    found = snapshots.power_ratings(spark, snapshot_folder(spark, sf_dir, "power_ratings"))
    return found.drop("wow", "ytd")


@query(
    "drop_preamble",
    f"SELECT team, a AS off_rating, b AS def_rating, CAST(n AS DOUBLE) AS overall FROM {_C}",
    "off_rating def_rating overall",
)
def _(spark, sf_dir):
    """The preamble and its byte-order mark are gone, the data rows are whole."""
    files = snapshots.resolve_files(spark, snapshot_folder(spark, sf_dir, "power_ratings"), "power_ratings", "beta")
    cells = snapshots.raw_cells(spark, "power_ratings", files)
    _, rows = snapshots.drop_preamble(cells, ["team"])
    cell = snapshots.cell
    return rows.select(
        cell("team").alias("team"), cell("off.").cast("double").alias("off_rating"), cell("def.").cast("double").alias("def_rating"), cell("ovr.").cast("double").alias("overall")
    )


@query("epa_tiers", f"SELECT team, a AS epa_off, b AS epa_def, a - b AS epa_margin FROM {_R}", "epa_off epa_def epa_margin")
def _(spark, sf_dir):
    return snapshots.epa_tiers(spark, snapshot_folder(spark, sf_dir, "epa_tiers")).select("team", "epa_off", "epa_def", "epa_margin")


@query("strength_of_schedule", f"SELECT team, a AS original_rating, b AS opponent_rating, CAST(n AS DOUBLE) AS sos_rank FROM {_R}", "original_rating opponent_rating")
def _(spark, sf_dir):
    return snapshots.strength_of_schedule(spark, snapshot_folder(spark, sf_dir, "strength_of_schedule")).select("team", "original_rating", "opponent_rating", "sos_rank")


@query(
    "strength_all_columns",
    f"""SELECT team, a AS opponent_rating, CAST(n AS DOUBLE) AS sos_rank, a - 1 AS past_opponent_rating, CAST(n + 1 AS DOUBLE) AS past_rank, b AS future_opponent_rating,
    CAST(n + 2 AS DOUBLE) AS future_rank, CAST(n * 2 AS VARCHAR) AS po, CAST(n * 3 AS VARCHAR) AS vs_avg, 'x' AS unnamed, CAST(n + 2 AS VARCHAR) AS third_rank FROM {_R}""",
    "opponent_rating past_opponent_rating future_opponent_rating",
)
def _(spark, sf_dir):
    """Three pairs of equally named columns, columns that the layout does not know and one without a header."""
    folder, s = scratch_path(spark, "snapshots"), _per_team(supplier_ratings(spark, sf_dir))
    header = "Team,PO%,Avg. Opp. Rating,Rank,Avg. Opp. Rating,Rank,Avg. Opp. Rating,Rank,vs Avg,"
    n = F.col("n")
    body = s.select(F.concat_ws(",", "team", n * 2, "a", n, F.col("a") - 1, n + 1, "b", n + 2, n * 3, F.lit("x")).alias("value"))
    spark.createDataFrame([(header,)], "value string").coalesce(1).union(body.coalesce(1)).coalesce(1).write.text(f"{folder}/strength_of_schedule_alpha_2025_week_1.csv")
    found = snapshots.scan_provider_snapshots(spark, folder, "strength_of_schedule", cells_as="cells")
    return found.select(
        "team", "opponent_rating", "sos_rank", "past_opponent_rating", "past_rank", "future_opponent_rating", "future_rank", F.col("cells")["po%"].alias("po"),
        F.col("cells")["vs avg"].alias("vs_avg"), F.col("cells")["column_10"].alias("unnamed"), F.col("cells")["rank.2"].alias("third_rank"),
    )


@query("qb_epa", "SELECT 'Player ' || CAST(c_custkey AS VARCHAR) AS player, lower('T' || CAST(c_custkey % 32 AS VARCHAR)) AS team, CAST(c_custkey % 500 AS DOUBLE) AS plays, c_acctbal AS epa FROM customer")
def _(spark, sf_dir):
    return snapshots.qb_epa(spark, snapshot_folder(spark, sf_dir, "qb_epa")).select("player", "team", "plays", "epa")


@query(
    "weekly_projections",
    sql("SELECT strftime(gameday, '%Y-%m-%d') AS date, away_team || ' at ' || home_team AS matchup, 'T -' || CAST(game_id % 15 AS VARCHAR) AS favorite_line, CAST(game_id % 100 AS DOUBLE) AS win_prob, true AS legacy FROM G", "G"),
)
def _(spark, sf_dir):
    found = snapshots.weekly_projections(spark, snapshot_folder(spark, sf_dir, "weekly_projections_ppg"))
    return found.select("date", "matchup", "favorite_line", "win_prob", "legacy")


@query(
    "load_sources",
    f"""SELECT r.team, r.a AS rating, e.a AS epa_off, c.a AS off_rating, q.epa FROM {_R} r JOIN {_R} e USING (team) LEFT JOIN {_C} c ON c.team = r.team
    LEFT JOIN (SELECT 'T' || CAST(c_custkey % 32 AS VARCHAR) AS team, max_by(c_acctbal, (c_custkey % 500, 'Player ' || CAST(c_custkey AS VARCHAR))) AS epa FROM customer GROUP BY 1) q ON q.team = r.team""",
    "rating epa_off off_rating epa",
)
def _(spark, sf_dir):
    """Base ratings, EPA tiers, a second provider, the busiest passer, and a source that is not there."""
    folder = snapshot_folder(spark, sf_dir, "power_ratings", "epa_tiers", "qb_epa")
    aliases = team_ratings(spark, sf_dir).select(F.col("team").alias("alias"), F.col("team").alias("code"))
    merged, _ = snapshots.load_sources(
        spark, folder, 2025, 1,
        [("power_ratings", "alpha"), ("epa_tiers", "alpha"), ("power_ratings", "beta"), ("qb_epa", "beta"), ("strength_of_schedule", "gamma")], aliases,
    )
    return merged.select("team", "rating", "epa_off", F.col("off_rating_power_ratings_beta").alias("off_rating"), "epa")


@query("scan_reference", "SELECT n_name, CAST(n_nationkey AS INTEGER) AS n_nationkey, CAST(n_regionkey AS INTEGER) AS n_regionkey, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def _(spark, sf_dir):
    path = scratch_path(spark, "nations") + ".csv"
    table(spark, sf_dir, "nation").write.option("header", True).csv(path)
    nations = tables.scan_reference(spark, path, {"n_nationkey": "int", "n_regionkey": "int"})
    held = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    return nations.join(held, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(
        "n_name", "n_nationkey", "n_regionkey", F.coalesce("suppliers", F.lit(0)).alias("suppliers")
    )


_ADJ_TEXT = "CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' ELSE CAST(c_acctbal AS STRING) END"


@query(
    "scan_adjustments",
    """SELECT c_name AS team, CASE WHEN c_custkey % 7 > 1 THEN c_acctbal END AS adjustment, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS reason,
    CASE c_custkey % 7 WHEN 0 THEN 'missing adjustment' WHEN 1 THEN 'not a number' END AS rejected FROM customer""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "adjustments")
    table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("team"), F.expr(_ADJ_TEXT).alias("adjustment"), F.expr("CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS reason")
    ).write.parquet(path)
    good, bad = tables.scan_adjustments(spark, path)
    return good.withColumn("rejected", F.lit(None).cast("string")).unionByName(
        bad.select("team", F.lit(None).cast("double").alias("adjustment"), F.coalesce("reason", F.lit("")).alias("reason"), "rejected")
    )


_SNAPS = """(SELECT event_type AS category, 'p' || CAST(user_id % 50 AS VARCHAR) AS provider, CAST(year(ts) AS INTEGER) AS season, CAST(month(ts) * 100 + day(ts) AS INTEGER) AS week, value FROM events)"""
_EXPECTED = "(SELECT unnest(['click', 'view', 'absent']) AS category, unnest(['p0', 'p1', 'p9']) AS provider, unnest([true, true, false]) AS required)"
_COMPLETE = f"""(SELECT *, bool_and(ok OR NOT required) OVER (PARTITION BY season, week) AS week_complete FROM (
  SELECT w.season, w.week, e.category, e.provider, e.required, coalesce(c.row_count, 0) AS row_count, coalesce(c.valid_rows, 0) AS valid_rows, coalesce(c.valid_rows, 0) > 0 AS ok
  FROM (SELECT DISTINCT season, week FROM {_SNAPS}) w CROSS JOIN {_EXPECTED} e
  LEFT JOIN (SELECT category, provider, season, week, count(*) AS row_count, count(*) FILTER (value > 1) AS valid_rows FROM {_SNAPS} GROUP BY ALL) c
    ON c.category = e.category AND c.provider = e.provider AND c.season = w.season AND c.week = w.week))"""


def _completeness(spark, sf_dir):
    """With fifty providers some have nothing on some days, and one never has anything."""
    found = table(spark, sf_dir, "events").selectExpr(
        "event_type AS category", "concat('p', user_id % 50) AS provider", "year(ts) AS season", "month(ts) * 100 + day(ts) AS week", "value"
    )
    expected = [("click", "p0", True), ("view", "p1", True), ("absent", "p9", False)]
    return snapshots.source_completeness(found, expected, F.col("value") > 1)


@query("source_completeness", f"SELECT * FROM {_COMPLETE}")
def _(spark, sf_dir):
    return _completeness(spark, sf_dir)


@query(
    "source_diagnosis",
    f"""SELECT season, week, category, provider, required, CASE category WHEN 'click' THEN 'epa_margin' WHEN 'absent' THEN 'qb_adj' END AS disabled_feature,
    CASE category WHEN 'click' THEN 0.0::double WHEN 'absent' THEN 1.5::double END AS default_value FROM {_COMPLETE} WHERE NOT ok""",
)
def _(spark, sf_dir):
    return quality.source_diagnosis(_completeness(spark, sf_dir), {"click/p0": ("epa_margin", 0.0), "absent/p9": ("qb_adj", 1.5)})
