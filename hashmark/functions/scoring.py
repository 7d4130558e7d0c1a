"""Scoring and situational adjustments on game rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the rating model and its fallbacks.
HOME_FIELD_ADVANTAGE = 2.5
BASE_WEIGHTS = {"epa_margin": 35.0, "rating": 0.02, "overall": 0.5}
STRUCTURAL_WEIGHTS = {"rest_days": 0.3, "win_rate_L5": 5.0, "qb_adj": 0.1}

# Fixed values of the situational model: points, and rating points turned into points.
SITUATIONAL_INTERCEPT = 2.67
SITUATIONAL_SLOPE = 0.0447
RATING_TO_POINTS = 0.05
BYE_RATING = 1.0
SHORT_WEEK_RATING = -2.5
DIVISION_RATING = -8.3
BYE_DAYS = 14
FULL_WEEK_DAYS = 7

# Fixed values of the form adjustment.
HOT_WINS, COLD_WINS, FORM_POINTS = 4, 1, 0.5

# Fixed values of the confidence ladder, strongest first.
CONFIDENCE_LADDER = ((3.0, "HIGH"), (2.5, "MODERATE-HIGH"), (2.0, "MODERATE"))
CONFIDENCE_FLOOR = "LOW"


def result_flags(
    df: DataFrame, home_score: str = "home_score", away_score: str = "away_score", line: str | None = "home_line"
) -> DataFrame:
    """Win flags, point difference and cover flags; an unplayed game or a missing line gives NULL."""
    margin = F.col(home_score) - F.col(away_score)
    out = {
        "home_win": (margin > 0).cast("int"),
        "away_win": (margin < 0).cast("int"),
        "point_diff": margin,
    }
    if line is not None:
        cover = margin + F.col(line)
        out |= {
            "home_ats_margin": cover,
            "home_ats_cover": (cover > 0).cast("int"),
            "away_ats_cover": F.lit(1) - (cover > 0).cast("int"),
        }
    return df.withColumns(out)


def side_differences(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Add ``name = home - away`` for each ``name: (home, away)``."""
    return df.withColumns({name: F.col(h) - F.col(a) for name, (h, a) in pairs.items()})


def rest_from_modifiers(
    df: DataFrame, home: str = "home_bye_mod", away: str = "away_bye_mod", name: str = "rest_advantage"
) -> DataFrame:
    """Sum of the two bye modifiers, a missing one counting 0; a missing column is an error."""
    absent = [c for c in (home, away) if c not in df.columns]
    if absent:
        raise ValueError(f"rest needs the columns {absent}")
    zero = F.lit(0.0)
    return df.withColumn(name, F.coalesce(F.col(home).cast("double"), zero) + F.coalesce(F.col(away).cast("double"), zero))


def _one_sided(home: Column, away: Column) -> Column:
    """+1 when only the home side qualifies, -1 when only the away side does, else 0."""
    return F.coalesce(home.cast("int"), F.lit(0)) - F.coalesce(away.cast("int"), F.lit(0))


def rest_situation(df: DataFrame, home_rest: str = "home_rest", away_rest: str = "away_rest") -> DataFrame:
    """Bye-flag difference and the rest adjustment in points (0 unless both rests are known)."""
    h, a = F.col(home_rest), F.col(away_rest)
    bye = _one_sided(h >= BYE_DAYS, a >= BYE_DAYS)
    short = _one_sided(h < FULL_WEEK_DAYS, a < FULL_WEEK_DAYS)
    points = (bye * BYE_RATING + short * SHORT_WEEK_RATING) * RATING_TO_POINTS
    known = h.isNotNull() & a.isNotNull()
    return df.withColumns({"bye_diff": bye, "rest_adj": F.when(known, points).otherwise(F.lit(0.0))})


def situational_spread(
    df: DataFrame,
    rating_diff: str = "rating_diff",
    home_rest: str = "home_rest",
    away_rest: str = "away_rest",
    div_game: str = "div_game",
) -> DataFrame:
    """Base spread plus rest and division adjustments, with the breakdown kept."""
    division = F.when(F.col(div_game) == 1, F.lit(DIVISION_RATING * RATING_TO_POINTS)).otherwise(F.lit(0.0))
    return (
        rest_situation(df, home_rest, away_rest)
        .withColumns({
            "base_spread": F.lit(SITUATIONAL_INTERCEPT) + F.col(rating_diff) * SITUATIONAL_SLOPE,
            "div_adj": division,
            "surface_adj": F.lit(0.0),
        })
        .withColumn(
            "predicted_spread",
            F.col("base_spread") + F.col("rest_adj") + F.col("div_adj") + F.col("surface_adj"),
        )
    )


def hot_cold_adjustment(df: DataFrame, home_wins: str, away_wins: str) -> DataFrame:
    """Last-five-wins adjustment: a hot home side or a cold away side moves the line by -0.5, and so on."""

    def heat(c: str) -> Column:
        return F.when(F.col(c) >= HOT_WINS, F.lit(1.0)).when(F.col(c) <= COLD_WINS, F.lit(-1.0)).otherwise(F.lit(0.0))

    return df.withColumns({
        "home_form_adj": heat(home_wins) * -FORM_POINTS,
        "away_form_adj": heat(away_wins) * FORM_POINTS,
    }).withColumn("form_adj", F.col("home_form_adj") + F.col("away_form_adj"))


def flip_perspective(col: Column) -> Column:
    """Away-perspective line as a home-perspective line."""
    return F.negative(col)


def linear_score(intercept: float, coefficients: Mapping[str, float]) -> Column:
    """Intercept plus the weighted sum of the named columns; NULL if any of them is NULL."""
    return reduce(
        lambda acc, term: acc + F.col(term[0]) * F.lit(float(term[1])), coefficients.items(), F.lit(float(intercept))
    )


def weighted_rating_score(
    terms: Sequence[tuple[str, str, float]], hfa: float = HOME_FIELD_ADVANTAGE
) -> Column:
    """``-hfa - sum((home - away) * weight)``; a term with a missing side is left out."""
    total = reduce(
        lambda acc, t: acc + F.coalesce((F.col(t[0]) - F.col(t[1])) * F.lit(float(t[2])), F.lit(0.0)),
        terms,
        F.lit(0.0),
    )
    return F.lit(-float(hfa)) - total


def rating_terms(weights: Mapping[str, float], home: str = "{}_home", away: str = "{}_away") -> list[tuple[str, str, float]]:
    """Suffixed column pairs for a weight table."""
    return [(home.format(n), away.format(n), w) for n, w in weights.items()]


def edge_columns(df: DataFrame, pred: str = "pred", line: str = "home_line", home: str | None = None, away: str | None = None) -> DataFrame:
    """Edge against the line, its size, the side it favours and, with team columns, a recommendation."""
    edge = F.col(pred) - F.col(line)
    out = {
        "edge": edge,
        "abs_edge": F.abs(edge),
        "bet_side": F.when(edge < 0, F.lit("home")).when(edge.isNotNull(), F.lit("away")),
    }
    if home and away:
        out["recommendation"] = F.when(edge < 0, F.concat(F.lit("Bet "), F.col(home))).when(
            edge.isNotNull(), F.concat(F.lit("Bet "), F.col(away))
        )
    return df.withColumns(out)


def confidence_band(size: Column) -> Column:
    """Label of an absolute edge."""
    ladder = reduce(
        lambda acc, step: acc.when(size >= step[0], F.lit(step[1])),
        CONFIDENCE_LADDER[1:],
        F.when(size >= CONFIDENCE_LADDER[0][0], F.lit(CONFIDENCE_LADDER[0][1])),
    )
    return ladder.when(size.isNotNull(), F.lit(CONFIDENCE_FLOOR))


def value_filter(df: DataFrame, min_edge: float = 0.5, edge: str = "edge") -> DataFrame:
    """Rows whose absolute edge reaches the threshold."""
    return df.filter(F.abs(F.col(edge)) >= float(min_edge))


def season_split(cutoff: int, season: str = "season") -> Column:
    """``train`` before the cutoff season, ``test`` from it on."""
    return F.when(F.col(season) < cutoff, F.lit("train")).otherwise(F.lit("test"))


def bet_sizing(df: DataFrame, pred: str = "pred", sigma: float | Column = 2.0, odds: float = -110.0, stake: float = 100.0) -> DataFrame:
    """Side probability, expected value and Kelly shares of a scored slate (needs ``bet_side``)."""
    from hashmark.functions import pricing

    scale = sigma if isinstance(sigma, Column) else F.lit(float(sigma))
    return (
        df.withColumn("__z", F.try_divide(F.negative(F.col(pred)), scale))
        .withColumn("__size", F.coalesce(F.abs("__z"), F.lit(0.0)))
        .withColumn("home_win_prob", pricing.normal_cdf(F.col("__z"), F.col("__size")))
        .drop("__z", "__size")
        .withColumns({
            "away_win_prob": F.lit(1.0) - F.col("home_win_prob"),
            "bet_prob": F.when(F.col("bet_side") == "home", F.col("home_win_prob"))
            .when(F.col("bet_side") == "away", F.lit(1.0) - F.col("home_win_prob")),
        })
        .withColumns({
            "ev_dollars": pricing.ev_dollars(F.col("bet_prob"), F.lit(float(odds)), stake),
            "kelly_full": pricing.kelly_full(F.col("bet_prob"), F.lit(float(odds))),
        })
        .withColumn("kelly_quarter", F.col("kelly_full") * pricing.KELLY_SHARE)
    )
