"""Backtests of several models in one pass, and the weekly slate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashmark.functions.keys import format_game_key
from hashmark.functions.scoring import (
    BASE_WEIGHTS, HOME_FIELD_ADVANTAGE, STRUCTURAL_WEIGHTS, bet_sizing, edge_columns, rating_terms, season_split,
    weighted_rating_score,
)
from hashmark.operators.joins import apply_adjustments, join_both_sides, score_models
from hashmark.operators.models import residual_std
from hashmark.operators.reports import backtest_by_season, compare_models

# Coefficients of the two published linear models, home perspective.
REGISTRY: Mapping[str, Mapping[str, float]] = {
    "v1.0": {"intercept": 2.67, "rating_diff": 0.0447},
    "v1.2": {
        "intercept": -1.8373, "rating_diff": -0.0409, "rest_advantage": -0.0278, "div_game": 0.0037,
        "surface_mod": -0.0098, "time_advantage": -0.0073, "qb_diff": -0.0408,
    },
}


def score_games(
    dataset: DataFrame, registry: Mapping[str, Mapping[str, float]] = REGISTRY, models: Sequence[str] | None = None,
    line: str = "closing_spread", away_perspective: Sequence[str] = (),
) -> DataFrame:
    """Every game scored by every chosen model, with edges against the line.

    Models fitted on away-perspective lines are listed in ``away_perspective`` and flipped here.
    """
    scored = score_models(dataset, registry, models)
    if away_perspective:
        scored = scored.withColumn(
            "pred", F.when(F.col("model").isin(*away_perspective), F.negative(F.col("pred"))).otherwise(F.col("pred"))
        )
    return edge_columns(scored, "pred", line)


def backtest(dataset: DataFrame, threshold: float = 0.5, **scoring) -> DataFrame:
    """Season backtest of all models: one scan of the games, one shuffle of a row per (model, season)."""
    return backtest_by_season(score_games(dataset, **scoring), threshold)


def compare(dataset: DataFrame, threshold: float = 0.5, **scoring) -> DataFrame:
    """Model comparison over the season backtests."""
    return compare_models(backtest(dataset, threshold, **scoring))


def size_bets(scored: DataFrame, cutoff: int) -> DataFrame:
    """Probabilities, expected value and Kelly shares, with sigma measured on the test seasons."""
    split = scored.withColumn("data_split", season_split(cutoff))
    sigma = residual_std(split).filter(F.col("data_split") == "test").first()
    if sigma is None or not sigma["residual_std"]:
        raise ValueError("no test season to measure sigma on")
    return bet_sizing(split, "pred", sigma["residual_std"])


def slate_weights(model: str, registry: DataFrame | None = None) -> dict[str, float]:
    """A rating model's weights: from the registry, and from the published table for terms it lacks.

    A model is known if either has it; a registry holds a row for each of a model's few terms.
    """
    published = {"v1.0": BASE_WEIGHTS, "v1.1": {**BASE_WEIGHTS, **STRUCTURAL_WEIGHTS}}
    own = {}
    if registry is not None:
        rows = registry.filter((F.col("model") == model) & F.col("weight").isNotNull() & ~F.isnan(F.col("weight"))).select("term", "weight").collect()
        own = {r["term"]: r["weight"] for r in rows}
    if model not in published and not own:
        raise KeyError(f"unknown model {model}")
    return {**published.get(model, {}), **own}


def weekly_slate(
    matchups: DataFrame,
    ratings: DataFrame,
    adjustments: DataFrame,
    model: str = "v1.1",
    hfa: float = HOME_FIELD_ADVANTAGE,
    line: str = "home_line",
    weights: Mapping[str, float] | None = None,
    registry: DataFrame | None = None,
) -> DataFrame:
    """Ratings on both sides, the rating model's line, manual adjustments and the edge of each game.

    Weights are given, or those of the model in a ``registry`` table of (model, term, weight) with the published ones for
    terms that it lacks.  The output has the same columns with and without adjustments; an unknown model is an error.
    """
    weights = weights or slate_weights(model, registry)
    weights = {n: w for n, w in weights.items() if n in ratings.columns}
    slate = matchups.select("season", "week", "away_team", "home_team", line)
    sides = join_both_sides(slate, ratings.select("team", *weights))
    scored = sides.withColumn("raw_line", weighted_rating_score(rating_terms(weights), hfa))
    final = apply_adjustments(scored.withColumn("model_line", F.bround("raw_line", 1)), adjustments)
    edge = F.bround(F.col("final_line") - F.col(line), 1)
    # without an adjustment the edge comes from the unrounded line, with one from the adjusted line
    untouched = (F.col("subjective_home") == 0) & (F.col("subjective_away") == 0)
    return final.select(
        format_game_key().alias("game_id"), "season", "week", "away_team", "home_team", F.lit(model).alias("model"),
        "model_line", F.col(line).alias("market_line"),
        "subjective_home", "subjective_away", "subjective_reason_home", "subjective_reason_away",
        F.bround("final_line", 1).alias("final_line"),
        F.when(untouched, F.bround(F.col("raw_line") - F.col(line), 1)).otherwise(edge).alias("edge"),
    )
