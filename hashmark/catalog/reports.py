"""Scoring, backtests, threshold and bin reports over the scored games."""

from __future__ import annotations

from pyspark.sql import functions as F

from hashmark.catalog.bindings import games, sql, table
from hashmark.catalog.games import R_SQL, team_ratings
from hashmark.catalog.registry import query
from hashmark.functions import scoring
from hashmark.operators import joins, reports, windows
from hashmark.plans import datasets, evaluation

CUTOFF = 2000


def dataset(spark, sf_dir):
    return datasets.structural_dataset(games(spark, sf_dir), key=None)


def scored(spark, sf_dir):
    return evaluation.score_games(dataset(spark, sf_dir))


def sized(spark, sf_dir):
    return evaluation.size_bets(evaluation.score_games(dataset(spark, sf_dir), models=["v1.2"]), CUTOFF)


# ---- scoring -------------------------------------------------------------------------------------


@query("linear_score", sql("SELECT game_id, pred FROM SC WHERE model = 'v1.2'", "SC"), "pred")
def _(spark, sf_dir):
    terms = dict(evaluation.REGISTRY["v1.2"])
    return dataset(spark, sf_dir).select("game_id", scoring.linear_score(terms.pop("intercept"), terms).alias("pred"))


@query("score_models", sql("SELECT game_id, model, pred FROM SC", "SC"), "pred")
def _(spark, sf_dir):
    """The registry is written and read as a table first, as a scoring job would find it."""
    registry = joins.read_registry(joins.registry_frame(spark, evaluation.REGISTRY))
    return joins.score_models(dataset(spark, sf_dir), registry).select("game_id", "model", "pred")


@query(
    "weighted_rating_score",
    sql(
        f"""SELECT game_id, -2.5::double - (coalesce((h.rating - a.rating) * 0.02::double, 0) + coalesce((home_qb_adj - away_qb_adj) * 0.1::double, 0)
          + coalesce((home_rest - away_rest) * 0.3::double, 0)) AS score
        FROM G LEFT JOIN {R_SQL} h ON h.team = home_team LEFT JOIN {R_SQL} a ON a.team = away_team""",
        "G", "R",
    ),
    "score",
)
def _(spark, sf_dir):
    g = games(spark, sf_dir).select("game_id", "home_team", "away_team", "home_qb_adj", "away_qb_adj", "home_rest", "away_rest")
    both = joins.join_both_sides(g, team_ratings(spark, sf_dir))
    terms = [("rating_home", "rating_away", 0.02), ("home_qb_adj", "away_qb_adj", 0.1), ("home_rest", "away_rest", 0.3)]
    return both.select("game_id", scoring.weighted_rating_score(terms).alias("score"))


@query(
    "edge_columns",
    sql(
        """SELECT game_id, model, edge, abs_edge, bet_side, 'Bet ' || CASE WHEN edge < 0 THEN home_team ELSE away_team END AS recommendation FROM SC""",
        "SC",
    ),
    "edge abs_edge",
)
def _(spark, sf_dir):
    both = joins.score_models(dataset(spark, sf_dir), evaluation.REGISTRY)
    out = scoring.edge_columns(both, "pred", "closing_spread", "home_team", "away_team")
    return out.select("game_id", "model", "edge", "abs_edge", "bet_side", "recommendation")


@query(
    "confidence_band",
    sql(
        """SELECT game_id, model, CASE WHEN abs_edge >= 3.0 THEN 'HIGH' WHEN abs_edge >= 2.5 THEN 'MODERATE-HIGH' WHEN abs_edge >= 2.0 THEN 'MODERATE' ELSE 'LOW' END AS confidence FROM SC""",
        "SC",
    ),
)
def _(spark, sf_dir):
    return scored(spark, sf_dir).select("game_id", "model", scoring.confidence_band(F.col("abs_edge")).alias("confidence"))


_ADJ = """(SELECT s_suppkey % 32 AS k, 'T' || CAST(s_suppkey % 32 AS VARCHAR) AS team, max(s_acctbal) / 1000.0 AS adjustment, 'form' AS reason
  FROM supplier WHERE s_suppkey % 32 % 3 = 0 GROUP BY s_suppkey % 32)"""


def adjustments(spark, sf_dir):
    chosen = team_ratings(spark, sf_dir).filter(F.substring("team", 2, 3).cast("int") % 3 == 0)
    return chosen.select("team", (F.col("rating") / 1000.0).alias("adjustment"), F.lit("form").alias("reason"))


@query(
    "apply_adjustments",
    sql(
        f"""SELECT game_id, coalesce(h.adjustment, 0) AS subjective_home, coalesce(a.adjustment, 0) AS subjective_away,
        coalesce(h.reason, '') AS subjective_reason_home, coalesce(a.reason, '') AS subjective_reason_away,
        pred + (coalesce(h.adjustment, 0) - coalesce(a.adjustment, 0)) AS final_line
        FROM SC LEFT JOIN {_ADJ} h ON h.team = home_team LEFT JOIN {_ADJ} a ON a.team = away_team WHERE model = 'v1.2'""",
        "SC",
    ),
    "subjective_home subjective_away final_line",
)
def _(spark, sf_dir):
    lines = evaluation.score_games(dataset(spark, sf_dir), models=["v1.2"]).select("game_id", "home_team", "away_team", "pred")
    return joins.apply_adjustments(lines, adjustments(spark, sf_dir)).drop("home_team", "away_team", "pred")


@query(
    "weekly_slate",
    sql(
        f"""SELECT game_key AS game_id, season, week, away_team, home_team, 'v1.0' AS model, round_even(raw, 1) + 0.0 AS model_line, home_line AS market_line,
        sh AS subjective_home, sa AS subjective_away, rh AS subjective_reason_home, ra AS subjective_reason_away,
        round_even(round_even(raw, 1) + (sh - sa), 1) + 0.0 AS final_line,
        round_even(CASE WHEN sh = 0 AND sa = 0 THEN raw ELSE round_even(raw, 1) + (sh - sa) END - home_line, 1) + 0.0 AS edge FROM (
          SELECT game_key, season, week, away_team, home_team, home_line, -2.5037::double - coalesce((h.rating - a.rating) * 0.02::double, 0) AS raw,
            coalesce(x.adjustment, 0) AS sh, coalesce(y.adjustment, 0) AS sa, coalesce(x.reason, '') AS rh, coalesce(y.reason, '') AS ra
          FROM K LEFT JOIN {R_SQL} h ON h.team = home_team LEFT JOIN {R_SQL} a ON a.team = away_team
          LEFT JOIN {_ADJ} x ON x.team = home_team LEFT JOIN {_ADJ} y ON y.team = away_team)""",
        "K", "R",
    ),
    "subjective_home subjective_away model_line final_line edge",
)
def _(spark, sf_dir):
    # the home advantage keeps lines off exact halves of a tenth, which the two engines may round apart
    return evaluation.weekly_slate(games(spark, sf_dir), team_ratings(spark, sf_dir), adjustments(spark, sf_dir), model="v1.0", hfa=2.5037)


_SIDE_RATINGS = f"""(SELECT r.team, rating, qb_adj, rest_days FROM {R_SQL} r LEFT JOIN (
  SELECT 'T' || CAST(c_custkey % 32 AS VARCHAR) AS team, max(c_acctbal) / 7000 AS qb_adj, CAST(count(*) % 7 AS DOUBLE) AS rest_days FROM customer GROUP BY 1) c ON c.team = r.team)"""


@query(
    "weekly_slate_registry",
    sql(
        f"""SELECT game_key AS game_id, season, week, 'v1.1' AS model, round_even(raw, 1) + 0.0 AS model_line, home_line AS market_line, round_even(raw - home_line, 1) + 0.0 AS edge FROM (
          SELECT game_key, season, week, home_line, -2.5037::double - coalesce((h.rating - a.rating) * 0.03::double, 0) - coalesce((h.rest_days - a.rest_days) * 0.3::double, 0)
            - coalesce((h.qb_adj - a.qb_adj) * 0.1::double, 0) AS raw FROM K LEFT JOIN {_SIDE_RATINGS} h ON h.team = home_team LEFT JOIN {_SIDE_RATINGS} a ON a.team = away_team)""",
        "K", "R",
    ),
    "model_line edge",
)
def _(spark, sf_dir):
    """The second rating model: one weight comes from the registry table, the others fall back to the published ones."""
    customers = table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("T"), (F.col("c_custkey") % 32).cast("string")).alias("team"))
    passers = customers.agg((F.max("c_acctbal") / 7000).alias("qb_adj"), (F.count("*") % 7).cast("double").alias("rest_days"))
    registry = joins.registry_frame(spark, {"v1.1": {"rating": 0.03}, "v9": {"rating": 7.0}})
    none = adjustments(spark, sf_dir).limit(0)
    ratings = team_ratings(spark, sf_dir).join(passers, "team", "left")
    slate = evaluation.weekly_slate(games(spark, sf_dir), ratings, none, model="v1.1", hfa=2.5037, registry=registry)
    return slate.select("game_id", "season", "week", "model", "model_line", "market_line", "edge")


@query("value_filter", sql("SELECT game_id, model, edge FROM SC WHERE abs_edge >= 2.0", "SC"), "edge")
def _(spark, sf_dir):
    return scoring.value_filter(scored(spark, sf_dir), 2.0).select("game_id", "model", "edge")


@query("season_split", sql("SELECT game_id, CASE WHEN season < 2000 THEN 'train' ELSE 'test' END AS data_split FROM G", "G"))
def _(spark, sf_dir):
    return games(spark, sf_dir).select("game_id", scoring.season_split(CUTOFF).alias("data_split"))


@query(
    "bet_sizing",
    sql("SELECT game_id, data_split, bet_side, home_win_prob, away_win_prob, bet_prob, ev_dollars, kelly_full, kelly_quarter FROM SB", "SB"),
    "home_win_prob away_win_prob bet_prob ev_dollars kelly_full kelly_quarter",
)
def _(spark, sf_dir):
    return sized(spark, sf_dir).select(
        "game_id", "data_split", "bet_side", "home_win_prob", "away_win_prob", "bet_prob", "ev_dollars", "kelly_full", "kelly_quarter"
    )


# ---- backtests -----------------------------------------------------------------------------------

_BACKTEST = """SELECT model, season, 0.5::double AS edge_threshold, count(*) AS n_games, count(*) FILTER (abs_edge >= 0.5) AS n_bets,
  avg(abs_edge) AS mae_vs_market, sqrt(avg(edge * edge)) AS rmse_vs_market, avg(edge) AS mean_edge FROM SC GROUP BY model, season"""


@query("backtest_by_season", sql(_BACKTEST, "SC"), "mae_vs_market rmse_vs_market mean_edge")
def _(spark, sf_dir):
    return evaluation.backtest(dataset(spark, sf_dir))


@query(
    "compare_models",
    sql(
        f"""SELECT model, count(*) AS seasons, CAST(sum(n_games) AS BIGINT) AS total_games, avg(mae_vs_market) AS avg_mae, avg(rmse_vs_market) AS avg_rmse,
        avg(mean_edge) AS avg_edge, stddev_samp(mean_edge) AS edge_std FROM ({_BACKTEST}) GROUP BY model""",
        "SC",
    ),
    "avg_mae avg_rmse avg_edge edge_std",
)
def _(spark, sf_dir):
    return evaluation.compare(dataset(spark, sf_dir))


@query(
    "season_report",
    sql("SELECT season, count(*) AS games, avg(abs_edge) AS mae, sqrt(avg(edge * edge)) AS rmse, sum(ev_dollars) AS total_ev FROM SB GROUP BY season", "SB"),
    "mae rmse total_ev", 2,
)
def _(spark, sf_dir):
    return reports.season_report(sized(spark, sf_dir), digits=9)


@query(
    "evaluate",
    sql(
        """SELECT model, avg(abs(actual_margin - pred)) AS mae, sqrt(avg((actual_margin - pred) * (actual_margin - pred))) AS rmse, count(*) AS n_games,
        avg(abs_edge) AS mean_edge, max(abs_edge) AS max_edge, avg(CASE WHEN (actual_margin > 0) = (pred > 0) THEN 1 ELSE 0 END) AS sign_accuracy
        FROM SC WHERE actual_margin IS NOT NULL GROUP BY model""",
        "SC",
    ),
    "mae rmse mean_edge max_edge sign_accuracy",
)
def _(spark, sf_dir):
    return reports.evaluate(scored(spark, sf_dir), "actual_margin", "pred", "closing_spread", keys=["model"])


@query(
    "r_squared",
    sql(
        """SELECT model, 1 - sum((closing_spread - pred) * (closing_spread - pred)) / (count(*) * var_pop(closing_spread)) AS r2 FROM SC GROUP BY model""",
        "SC",
    ),
    "r2",
)
def _(spark, sf_dir):
    return reports.r_squared(scored(spark, sf_dir), "closing_spread", "pred", keys=["model"])


_WON = "CAST((pred < closing_spread) = (actual_margin + closing_spread > 0) AS INTEGER)"
_BIN = "CASE WHEN abs_edge >= 5 THEN 5.0 WHEN abs_edge >= 3 THEN 3.0 WHEN abs_edge >= 2 THEN 2.0 WHEN abs_edge >= 1 THEN 1.0 ELSE 0.5 END"


@query(
    "roi_by_edge_bin",
    sql(
        f"""SELECT model, CAST(b AS DOUBLE) AS edge_bin, CASE WHEN b IS NULL THEN 'all' ELSE 'bin' END AS level, count(*) AS n_bets, avg(w) AS win_rate, (avg(w) - (1 - avg(w)) * 1.1) / 1.1 AS roi
        FROM (SELECT model, {_BIN} AS b, {_WON} AS w FROM SC WHERE actual_margin IS NOT NULL AND abs_edge >= 0.5) GROUP BY GROUPING SETS ((model, b), (model))""",
        "SC",
    ),
    "win_rate roi",
)
def _(spark, sf_dir):
    return reports.roi_by_edge_bin(scored(spark, sf_dir), line="closing_spread", keys=["model"])


_THRESHOLDS = "(SELECT unnest([0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0])::double AS threshold)"
_EV_THRESHOLDS = "(SELECT unnest([1.0, 1.5, 2.0, 2.5, 3.0])::double AS threshold)"


@query("at_thresholds", sql(f"SELECT threshold, model, season, count(*) AS n FROM SC JOIN {_THRESHOLDS} ON abs_edge >= threshold GROUP BY ALL", "SC"))
def _(spark, sf_dir):
    hit = joins.at_thresholds(scored(spark, sf_dir), reports.EDGE_THRESHOLDS)
    return hit.groupBy("threshold", "model", "season").agg(F.count("*").alias("n"))


@query(
    "edge_threshold_table",
    sql(
        f"""SELECT threshold, count(*) AS n_bets, count(*) * 100.0::double / (SELECT count(*) FROM SB) AS pct_of_games, avg(abs_edge) AS mean_edge,
        count(*)::double / (SELECT count(DISTINCT season) FROM SB) AS bets_per_season FROM SB JOIN {_THRESHOLDS} ON abs_edge >= threshold GROUP BY threshold""",
        "SB",
    ),
    "pct_of_games mean_edge bets_per_season",
)
def _(spark, sf_dir):
    return reports.edge_threshold_table(sized(spark, sf_dir))


@query(
    "edge_histogram",
    sql(
        """SELECT CAST(i AS INTEGER) AS bin, label, (SELECT count(*) FROM SB WHERE edge > lo AND edge <= hi) AS n FROM (
        SELECT unnest(range(8)) AS i, unnest(['<-10', '-10..-5', '-5..-2', '-2..0', '0..2', '2..5', '5..10', '>10']) AS label,
          unnest(['-infinity'::double, -10, -5, -2, 0, 2, 5, 10]) AS lo, unnest([-10, -5, -2, 0, 2, 5, 10, 'infinity'::double]) AS hi)""",
        "SB",
    ),
)
def _(spark, sf_dir):
    return reports.edge_histogram(
        sized(spark, sf_dir), [float("-inf"), -10, -5, -2, 0, 2, 5, 10, float("inf")], ["<-10", "-10..-5", "-5..-2", "-2..0", "0..2", "2..5", "5..10", ">10"]
    )


@query(
    "ev_by_threshold",
    sql(
        f"""SELECT threshold, count(*) AS bets, sum(ev_dollars) AS total_ev, avg(ev_dollars) AS mean_ev, count(*) * 100.0::double AS total_risk,
        sum(ev_dollars) / (count(*) * 100.0) AS ev_per_risk FROM SB JOIN {_EV_THRESHOLDS} ON abs_edge >= threshold GROUP BY threshold""",
        "SB",
    ),
    "total_ev mean_ev total_risk ev_per_risk", 4,
)
def _(spark, sf_dir):
    return reports.ev_by_threshold(sized(spark, sf_dir))


@query(
    "kelly_by_threshold",
    sql(
        f"""SELECT threshold, count(*) AS bets, avg(kelly_quarter) AS mean_kelly, median(kelly_quarter) AS median_kelly, max(kelly_quarter) AS max_kelly
        FROM SB JOIN {_EV_THRESHOLDS} ON abs_edge >= threshold GROUP BY threshold""",
        "SB",
    ),
    "mean_kelly median_kelly max_kelly",
)
def _(spark, sf_dir):
    return reports.kelly_by_threshold(sized(spark, sf_dir))


@query(
    "backtest_summary",
    sql(
        f"""SELECT CASE WHEN data_split IS NULL THEN 'overall' ELSE 'split' END AS scope, coalesce(data_split, 'overall') AS label, count(*) AS n,
        avg(abs_edge) AS mean_abs_edge, sqrt(avg(edge * edge)) AS rmse, sum(ev_dollars) AS total_ev, avg(ev_dollars) AS mean_ev, median(abs_edge) AS median_abs_edge
        FROM SB GROUP BY GROUPING SETS ((data_split), ())
        UNION ALL SELECT 'threshold', printf('%.1f+', threshold), count(*), avg(abs_edge), sqrt(avg(edge * edge)), sum(ev_dollars), avg(ev_dollars), median(abs_edge)
        FROM SB JOIN {_THRESHOLDS} ON abs_edge >= threshold GROUP BY threshold""",
        "SB",
    ),
    "mean_abs_edge rmse total_ev mean_ev median_abs_edge", 4,
)
def _(spark, sf_dir):
    return reports.backtest_summary(sized(spark, sf_dir))


@query(
    "summary_json",
    sql("SELECT coalesce(data_split, 'overall') AS label, count(*) AS n, round(median(abs_edge), 6) AS median_abs_edge FROM SB GROUP BY GROUPING SETS ((data_split), ())", "SB"),
    "median_abs_edge", 5,
)
def _(spark, sf_dir):
    """The summary as documents, read back from their text."""
    documents = reports.summary_json(reports.backtest_summary(sized(spark, sf_dir), [3.0])).filter("scope <> 'threshold'")
    read = F.from_json("document", "n long, median_abs_edge double, mean_ev double")
    return documents.select("label", read.alias("d")).select("label", "d.n", "d.median_abs_edge")


_BUCKETS = ", ".join(f"avg(abs(error)) FILTER (size >= {a} AND size < {b}) AS mae_spread_{a}_{b}" for a, b in reports.SPREAD_BUCKETS)


@query(
    "predictor_scorecard",
    sql(
        f"""SELECT predictor, count(*) AS n_games, avg(abs(error)) AS mae, sqrt(avg(error * error)) AS rmse, avg(error) AS mean_error, stddev_samp(error) AS std_error,
        avg(ok) AS ats_accuracy, CAST(sum(ok) AS BIGINT) AS ats_correct, {_BUCKETS},
        avg(abs(line - market)) FILTER (predictor <> 'closing_spread') AS mean_edge, max(abs(line - market)) FILTER (predictor <> 'closing_spread') AS max_edge,
        avg(beat) FILTER (predictor <> 'closing_spread') AS beat_market_pct, CAST(sum(beat) FILTER (predictor <> 'closing_spread') AS BIGINT) AS beat_market_games,
        median(error) AS median_error FROM (
          SELECT *, CAST(abs(error) < abs(-market - margin) AS INTEGER) AS beat, CAST(sign(-line) = sign(margin) AS INTEGER) AS ok FROM (
            SELECT *, abs(line) AS size, -line - margin AS error FROM (
              SELECT model AS predictor, pred AS line, closing_spread AS market, actual_margin AS margin FROM SC WHERE actual_margin IS NOT NULL
              UNION ALL SELECT 'closing_spread', closing_spread, closing_spread, actual_margin FROM DS WHERE actual_margin IS NOT NULL)))
        GROUP BY predictor""",
        "SC",
    ),
    "mae rmse mean_error std_error ats_accuracy mae_spread_0_3 mae_spread_3_7 mae_spread_7_14 mae_spread_14_100 mean_edge max_edge beat_market_pct median_error",
)
def _(spark, sf_dir):
    terms = {m: dict(t) for m, t in evaluation.REGISTRY.items()}
    wide = dataset(spark, sf_dir).select(
        "actual_margin", "closing_spread", *[scoring.linear_score(t.pop("intercept"), t).alias(m) for m, t in terms.items()]
    ).withColumnsRenamed({"v1.0": "v1_0", "v1.2": "v1_2"})
    card = reports.predictor_scorecard(wide, ["v1_0", "v1_2"], "closing_spread")
    return card.withColumn("predictor", F.regexp_replace("predictor", "^v1_", "v1."))


@query(
    "correlation_ranking",
    sql(
        """SELECT unnest(['rating_diff', 'rest_advantage', 'div_game', 'surface_mod', 'time_advantage', 'qb_diff']) AS feature,
        unnest([corr(rating_diff, closing_spread), corr(rest_advantage, closing_spread), corr(div_game, closing_spread), corr(surface_mod, closing_spread),
          corr(time_advantage, closing_spread), corr(qb_diff, closing_spread)]) AS correlation FROM DS""",
        "DS",
    ),
    "correlation",
)
def _(spark, sf_dir):
    return reports.correlation_ranking(dataset(spark, sf_dir), "closing_spread", datasets.STRUCTURAL_FEATURES)


_DESCRIBED = ("l_quantity", "l_extendedprice", "l_discount")


@query(
    "describe_columns",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max, max({c}) - min({c}) AS range,
        quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75 FROM lineitem"""
        for c in _DESCRIBED
    ),
    "mean std min max range q25 q50 q75", 4,
)
def _(spark, sf_dir):
    return reports.describe_columns(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), list(_DESCRIBED))


@query(
    "week_prediction_summary",
    sql(
        """SELECT model, season, week, count(*) AS games, avg(abs_edge) AS mean_abs_edge, stddev_samp(edge) AS std_edge, max(abs_edge) AS max_abs_edge,
        median(abs_edge) AS median_abs_edge FROM SC GROUP BY model, season, week""",
        "SC",
    ),
    "mean_abs_edge std_edge max_abs_edge median_abs_edge",
)
def _(spark, sf_dir):
    return reports.week_prediction_summary(scored(spark, sf_dir), keys=["model", "season", "week"])


@query(
    "cumulative_ev",
    sql("SELECT game_id, sum(ev_dollars) OVER (ORDER BY season, week, game_id) AS cumulative_ev FROM SB", "SB"),
    "cumulative_ev", 3,
)
def _(spark, sf_dir):
    bets = sized(spark, sf_dir).select("model", "season", "week", "game_id", "ev_dollars")
    return windows.cumulative_ev(bets, coarse=["season", "week"]).select("game_id", "cumulative_ev")


@query("top_edges", sql("SELECT game_id, season, edge FROM SB ORDER BY abs(edge) DESC, game_id LIMIT 10", "SB"), "edge")
def _(spark, sf_dir):
    return reports.top_edges(sized(spark, sf_dir)).select("game_id", "season", "edge")


@query(
    "top_edges_by_season",
    sql("SELECT game_id, season, edge, edge_rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY season ORDER BY abs_edge DESC, game_id) AS INTEGER) AS edge_rank FROM SB) WHERE edge_rank <= 5", "SB"),
    "edge",
)
def _(spark, sf_dir):
    return reports.top_edges(sized(spark, sf_dir), 5, by=["season"]).select("game_id", "season", "edge", "edge_rank")


@query("leaderboard", sql(f"SELECT team, rating FROM {R_SQL} ORDER BY rating DESC, team LIMIT 10", "R"))
def _(spark, sf_dir):
    return reports.leaderboard(team_ratings(spark, sf_dir), "rating")
