"""Backtest, threshold, bin and scorecard reports.  Every report is one aggregate over the scored rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashmark.functions.missing import missing_any
from hashmark.operators.ranks import percentiles_of_columns, percentiles_of_unions
from hashmark.operators.scale import exact_percentiles

# Fixed values of the reports.
EDGE_THRESHOLDS = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0)
EV_THRESHOLDS = (1.0, 1.5, 2.0, 2.5, 3.0)
ROI_BINS = (0.5, 1.0, 2.0, 3.0, 5.0)
SPREAD_BUCKETS = ((0, 3), (3, 7), (7, 14), (14, 100))
BET_RISK = 1.1
STAKE = 100.0


def _rmse(col: Column) -> Column:
    return F.sqrt(F.avg(col * col))


def backtest_by_season(scored: DataFrame, threshold: float = 0.5, keys: Sequence[str] = ("model", "season")) -> DataFrame:
    """Games, bets, MAE, RMSE and mean edge per model and season; a season without games has no row."""
    e = F.col("edge")
    return scored.filter(e.isNotNull()).groupBy(*keys).agg(
        F.lit(float(threshold)).alias("edge_threshold"),
        F.count("*").alias("n_games"),
        F.count_if(F.abs(e) >= threshold).alias("n_bets"),
        F.avg(F.abs(e)).alias("mae_vs_market"),
        _rmse(e).alias("rmse_vs_market"),
        F.avg(e).alias("mean_edge"),
    )


def compare_models(backtests: DataFrame) -> DataFrame:
    """One row per model over its season rows, best mean MAE first; the deviation is the sample one."""
    return (
        backtests.groupBy("model")
        .agg(
            F.count("*").alias("seasons"),
            F.sum("n_games").alias("total_games"),
            F.avg("mae_vs_market").alias("avg_mae"),
            F.avg("rmse_vs_market").alias("avg_rmse"),
            F.avg("mean_edge").alias("avg_edge"),
            F.stddev_samp("mean_edge").alias("edge_std"),
        )
        .orderBy("avg_mae", "model")
    )


def season_report(scored: DataFrame, digits: int = 2) -> DataFrame:
    """Games, MAE, RMSE and total expected value per season, rounded."""
    e = F.col("edge")
    return scored.groupBy("season").agg(
        F.count("*").alias("games"),
        F.bround(F.avg(F.abs(e)), digits).alias("mae"),
        F.bround(_rmse(e), digits).alias("rmse"),
        F.bround(F.sum("ev_dollars"), digits).alias("total_ev"),
    )


def evaluate(
    df: DataFrame, actual: str, pred: str, line: str | None = None, keys: Sequence[str] = (), with_r2: bool = False
) -> DataFrame:
    """MAE, RMSE and count, optionally R2; with a line also mean and largest edge and the share of equal signs.

    ``sign_accuracy`` compares the sign of outcome and prediction, not with the line; see
    ``roi_by_edge_bin`` for cover rates.
    """
    y, p = F.col(actual), F.col(pred)
    rows = df.filter(y.isNotNull() & p.isNotNull())
    out = [F.avg(F.abs(y - p)).alias("mae"), _rmse(y - p).alias("rmse"), F.count("*").alias("n_games")]
    if line is not None:
        edge = F.abs(p - F.col(line))
        out += [
            F.avg(edge).alias("mean_edge"),
            F.max(edge).alias("max_edge"),
            F.avg(((y > 0) == (p > 0)).cast("int")).alias("sign_accuracy"),
        ]
    if with_r2:
        out.append(_r2(y, p).alias("r2"))
    return rows.groupBy(*keys).agg(*out)


def _r2(y: Column, p: Column) -> Column:
    return F.lit(1.0) - F.try_divide(F.sum((y - p) * (y - p)), F.count("*") * F.var_pop(y))


def r_squared(df: DataFrame, actual: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """1 - SSE / SST; NULL for a constant outcome."""
    y, p = F.col(actual), F.col(pred)
    rows = df.filter(y.isNotNull() & p.isNotNull())
    return rows.groupBy(*keys).agg(_r2(y, p).alias("r2"))


def _right_open(size: Column, lows: Sequence[float]) -> Column:
    """Largest bound not above the value; NULL below the first."""
    bounds = sorted(float(b) for b in lows)
    return reduce(lambda acc, b: acc.when(size >= b, F.lit(b)), list(reversed(bounds))[1:], F.when(size >= bounds[-1], F.lit(bounds[-1])))


def roi_by_edge_bin(
    df: DataFrame, margin: str = "actual_margin", pred: str = "pred", line: str = "home_line", bins: Sequence[float] = ROI_BINS, keys: Sequence[str] = ()
) -> DataFrame:
    """Bets, win rate and return at -110 per edge bin ``[b, next b)``, plus an ``all`` row from the first bound up, for each of ``keys``."""
    m, p, q = F.col(margin), F.col(pred), F.col(line)
    won = ((p < q) == (m + q > 0)).cast("int")
    binned = (
        df.filter(m.isNotNull() & p.isNotNull() & q.isNotNull())
        .select(*keys, _right_open(F.abs(p - q), bins).alias("edge_bin"), won.alias("won"))
        .filter(F.col("edge_bin").isNotNull())
    )
    rate = F.avg("won")
    return (
        binned.groupingSets([[*keys, "edge_bin"], [*keys]], *keys, "edge_bin")
        .agg(
            F.when(F.grouping("edge_bin") == 1, F.lit("all")).otherwise(F.lit("bin")).alias("level"),
            F.count("*").alias("n_bets"),
            rate.alias("win_rate"),
            ((rate - (F.lit(1.0) - rate) * BET_RISK) / BET_RISK).alias("roi"),
        )
        .filter(F.col("n_bets") > 0)
        .select(*keys, "edge_bin", "level", "n_bets", "win_rate", "roi")
    )


def _threshold_rows(df: DataFrame, thresholds: Sequence[float], parts: Mapping[str, object]) -> DataFrame:
    """Conditional aggregates for every threshold in one pass, then one row per threshold.

    ``parts`` maps an output name to a function of the condition column.
    """
    columns = {
        (t, name): make(F.col("abs_edge") >= float(t)) for t in thresholds for name, make in parts.items()
    }
    wide = df.agg(F.count("*").alias("__n"), *[c.alias(f"t{i}_{n}") for i, t in enumerate(thresholds) for n, c in ((k[1], v) for k, v in columns.items() if k[0] == t)])
    return wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(float(t)).alias("threshold"),
                        F.col("__n").alias("total"),
                        *[F.col(f"t{i}_{n}").alias(n) for n in parts],
                    )
                    for i, t in enumerate(thresholds)
                ]
            )
        )
    )


def edge_threshold_table(df: DataFrame, thresholds: Sequence[float] = EDGE_THRESHOLDS, season: str = "season") -> DataFrame:
    """Per threshold: bets, share of all games, mean edge and bets per season.

    One scan per season first (map-side combined), so neither seasons nor rows are duplicated.
    """
    size = F.col("abs_edge")
    per_season = df.groupBy(season).agg(
        F.count("*").alias("__n"),
        *[F.count_if(size >= float(t)).alias(f"c{i}") for i, t in enumerate(thresholds)],
        *[F.sum(F.when(size >= float(t), size)).alias(f"s{i}") for i, t in enumerate(thresholds)],
    )
    wide = per_season.agg(
        F.sum("__n").alias("__n"), F.count(season).alias("__seasons"),
        *[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(thresholds))],
        *[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(thresholds))],
    )
    rows = F.array(*[
        F.struct(
            F.lit(float(t)).alias("threshold"), F.col(f"c{i}").alias("n_bets"),
            (F.try_divide(F.col(f"c{i}"), F.col("__n")) * 100.0).alias("pct_of_games"),
            F.try_divide(F.col(f"s{i}"), F.col(f"c{i}")).alias("mean_edge"),
            F.try_divide(F.col(f"c{i}"), F.col("__seasons")).alias("bets_per_season"),
        )
        for i, t in enumerate(thresholds)
    ])
    return wide.select(F.inline(rows))


def edge_histogram(df: DataFrame, cuts: Sequence[float], labels: Sequence[str], value: str = "edge") -> DataFrame:
    """Counts per right-closed bin ``(a, b]``; empty bins are listed with 0, values outside are not counted."""
    if len(cuts) != len(labels) + 1:
        raise ValueError("one label per bin")
    v = F.col(value)
    counts = df.agg(*[
        F.count_if((v > float(a)) & (v <= float(b))).alias(f"b{i}") for i, (a, b) in enumerate(zip(cuts, cuts[1:]))
    ])
    rows = [F.struct(F.lit(i).alias("bin"), F.lit(l).alias("label"), F.col(f"b{i}").alias("n")) for i, l in enumerate(labels)]
    return counts.select(F.inline(F.array(*rows)))


def ev_by_threshold(df: DataFrame, thresholds: Sequence[float] = EV_THRESHOLDS) -> DataFrame:
    """Bets, total and mean expected value, risk and return on risk per threshold."""
    ev = F.col("ev_dollars")
    rows = _threshold_rows(df, thresholds, {
        "bets": lambda hit: F.count_if(hit),
        "total_ev": lambda hit: F.sum(F.when(hit, ev)),
        "mean_ev": lambda hit: F.avg(F.when(hit, ev)),
    })
    return rows.filter(F.col("bets") > 0).select(
        "threshold", "bets", "total_ev", "mean_ev",
        (F.col("bets") * STAKE).alias("total_risk"),
        (F.col("total_ev") / (F.col("bets") * STAKE)).alias("ev_per_risk"),
    )


def _interval(thresholds: Sequence[float]) -> Column:
    """How many of the sorted thresholds an edge reaches; rows of one interval reach the same ones."""
    size = F.col("abs_edge")
    return reduce(lambda acc, t: acc + F.coalesce(size >= float(t), F.lit(False)).cast("int"), thresholds, F.lit(0))


def kelly_by_threshold(df: DataFrame, thresholds: Sequence[float] = EV_THRESHOLDS, value: str = "kelly_quarter") -> DataFrame:
    """Mean, exact median and largest Kelly share per threshold, merged from the intervals between thresholds."""
    k, bounds = F.col(value), sorted({float(t) for t in thresholds})
    table = percentiles_of_unions(
        df.select("abs_edge", value), {"interval": _interval(bounds)}, value, {"median_kelly": 0.5},
        lambda row: [(t,) for t in bounds[: row["interval"]]], "threshold double",
        {"bets": ("sum", F.count("*")), "max_kelly": ("max", F.max(k)), "total": ("sum", F.sum(k)), "filled": ("sum", F.count(k))},
    )
    return table.select("threshold", "bets", F.try_divide("total", "filled").alias("mean_kelly"), "max_kelly", "median_kelly")


def backtest_summary(df: DataFrame, thresholds: Sequence[float] = EDGE_THRESHOLDS, split: str = "data_split") -> DataFrame:
    """Overall, per split and per threshold figures in one long table.

    ``scope`` is overall, split or threshold and ``label`` names the part.  Rows are summed up once, by split and by interval
    between thresholds; every part is merged from these sums.
    """
    e, size, ev, bounds = F.col("edge"), F.col("abs_edge"), F.col("ev_dollars"), sorted({float(t) for t in thresholds})

    def parts(row) -> list[tuple[str, str]]:
        return [("overall", "overall"), ("split", row["split"]), *[("threshold", f"{t:.1f}+") for t in bounds[: row["interval"]]]]

    sums = {"n": F.count("*"), "s": F.sum(size), "ns": F.count(size), "ee": F.sum(e * e), "ne": F.count(e), "total_ev": F.sum(ev), "nv": F.count(ev)}
    table = percentiles_of_unions(
        df.select("edge", "abs_edge", "ev_dollars", F.col(split).cast("string").alias("split")), {"split": F.col("split"), "interval": _interval(bounds)}, "abs_edge",
        {"median_abs_edge": 0.5}, parts, "scope string, label string", {n: ("sum", c) for n, c in sums.items()},
    )
    return table.select(
        "scope", "label", "n", F.try_divide("s", "ns").alias("mean_abs_edge"), F.sqrt(F.try_divide("ee", "ne")).alias("rmse"), "total_ev",
        F.try_divide("total_ev", "nv").alias("mean_ev"), "median_abs_edge",
    )


def summary_json(summary: DataFrame) -> DataFrame:
    """The summary rows as JSON text, one document per row."""
    return summary.select("scope", "label", F.to_json(F.struct(*[c for c in summary.columns if c not in ("scope", "label")])).alias("document"))


def predictor_scorecard(
    df: DataFrame, predictors: Sequence[str], market: str, margin: str = "actual_margin", buckets=SPREAD_BUCKETS
) -> DataFrame:
    """Error, accuracy and edge figures of several line columns against results and the market line.

    Lines are home-perspective, so the predicted margin is minus the line; error = predicted - actual.
    A game falls into the bucket, ``[low, high)``, of the size of the predictor's own line.
    """
    m, q = F.col(margin), F.col(market)
    names = [*predictors, market] if market not in predictors else list(predictors)
    long = df.filter(m.isNotNull()).select(
        m.alias("margin"), q.alias("market"),
        F.inline(F.array(*[F.struct(F.lit(n).alias("predictor"), F.col(n).cast("double").alias("line")) for n in names])),
    ).filter(F.col("line").isNotNull()).withColumns({
        "error": F.negative(F.col("line")) - F.col("margin"), "size": F.abs("line"),
    })
    err, is_market = F.col("error"), F.col("predictor") == market
    market_error = F.abs(F.negative(F.col("market")) - F.col("margin"))
    right = (F.signum(F.negative(F.col("line"))) == F.signum(F.col("margin").cast("double"))).cast("int")
    edge = F.when(~is_market, F.abs(F.col("line") - F.col("market")))
    beats = F.when(~is_market, (F.abs(err) < market_error).cast("int"))
    figures = {
        "n_games": F.count("*"),
        "mae": F.avg(F.abs(err)),
        "rmse": _rmse(err),
        "mean_error": F.avg(err),
        "std_error": F.stddev_samp(err),
        "ats_accuracy": F.avg(right),
        "ats_correct": F.sum(right),
        **{
            f"mae_spread_{lo}_{hi}": F.avg(F.when((F.col("size") >= lo) & (F.col("size") < hi), F.abs(err)))
            for lo, hi in buckets
        },
        "mean_edge": F.avg(edge),
        "max_edge": F.max(edge),
        "beat_market_pct": F.avg(beats),
        "beat_market_games": F.sum(beats),
    }
    return exact_percentiles(long, ["predictor"], "error", {"median_error": 0.5}, figures)


def correlation_ranking(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Pearson correlation of each feature with the target, strongest first."""
    row = df.agg(*[F.corr(F.col(f).cast("double"), F.col(target).cast("double")).alias(f) for f in features])
    long = row.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("correlation")) for f in features])))
    return long.orderBy(F.abs("correlation").desc_nulls_last(), "feature")


def describe_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes, exact quartiles and range per column."""
    return percentiles_of_columns(df, columns, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, {
        "n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "range": lambda v: F.max(v) - F.min(v),
    })


def missing_feature_count(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, and rows with at least one missing column."""
    return df.agg(F.count("*").alias("row_count"), F.count_if(missing_any(columns)).alias("rows_missing"))


def line_availability(df: DataFrame, line: str = "home_line", keys: Sequence[str] = ("season", "week")) -> DataFrame:
    """Games and games with a line per period."""
    return df.groupBy(*keys).agg(F.count("*").alias("games"), F.count(line).alias("games_with_line"))


def week_prediction_summary(df: DataFrame, keys: Sequence[str] = ("season", "week")) -> DataFrame:
    """Games, mean, exact median, sample deviation and largest absolute edge of a scored period."""
    size = F.col("abs_edge")
    figures = {
        "games": F.count("*"), "mean_abs_edge": F.avg(size), "std_edge": F.stddev_samp("edge"), "max_abs_edge": F.max(size),
    }
    return exact_percentiles(df, list(keys), "abs_edge", {"median_abs_edge": 0.5}, figures)


def top_edges(df: DataFrame, k: int = 10, by: Sequence[str] = (), tie_break: Sequence[str] = ("game_id",), edge: str = "edge") -> DataFrame:
    """The ``k`` largest absolute edges, overall or within ``by``; ties are settled by ``tie_break``.

    Both forms keep ``k`` rows per task (and group) before anything is shuffled.
    """
    rows = df.filter(F.col(edge).isNotNull())
    order = [F.abs(F.col(edge)).desc(), *[F.col(c).asc() for c in tie_break]]
    if not by:
        return rows.orderBy(*order).limit(k)
    ranked = rows.withColumn("edge_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("edge_rank") <= k)


def leaderboard(df: DataFrame, by: str, k: int = 10, tie_break: Sequence[str] = ("team",)) -> DataFrame:
    """The ``k`` best rows by a rating."""
    return df.filter(F.col(by).isNotNull()).orderBy(F.col(by).desc(), *[F.col(c).asc() for c in tie_break]).limit(k)


def next_period(games: DataFrame, as_of, date: str = "gameday") -> DataFrame:
    """First (season, week) with a game on or after ``as_of``, else the last one."""
    period = F.struct("season", "week")
    coming = F.col(date) >= F.lit(as_of).cast("date")
    row = games.agg(
        F.min_by(period, F.when(coming, F.struct(F.col(date), F.col("game_id")))).alias("__next"),
        F.max(period).alias("__last"),
    )
    chosen = F.coalesce("__next", "__last")
    return row.select(chosen["season"].alias("season"), chosen["week"].alias("week"))


def week_lines(games: DataFrame, season: int, week: int, columns: Sequence[str], date: str = "gameday") -> DataFrame:
    """Market columns of one week in date order."""
    chosen = games.filter((F.col("season") == season) & (F.col("week") == week))
    return chosen.select("game_id", date, "away_team", "home_team", *columns).orderBy(date, "game_id")
