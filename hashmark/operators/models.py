"""Linear models from distributed sufficient statistics.

A fit reads its rows once: counts, means and centred cross products come from one map-side combined
aggregate, and only that p-by-p table reaches the driver for the solve.  Scores are column expressions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from hashmark.functions.missing import require_complete
from hashmark.functions.scoring import linear_score, season_split
from hashmark.operators.joins import registry_frame, score_models
from hashmark.operators.reports import evaluate
from hashmark.operators.scale import global_position

ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)


def sufficient_statistics(df: DataFrame, features: Sequence[str], target: str, by: Sequence[str] = ()) -> DataFrame:
    """Complete-case count, means and centred sums of products of all features and the target.

    ``mean_x``, ``s_x_y`` columns; centring inside the aggregate keeps badly scaled features accurate.
    """
    columns = [*features, target]
    rows = require_complete(df, columns)
    aggregates = [F.count("*").alias("n")]
    aggregates += [F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in columns]
    aggregates += [
        (F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")) * F.count("*")).alias(f"s_{a}_{b}")
        for i, a in enumerate(columns)
        for b in columns[i:]
    ]
    return rows.groupBy(*by).agg(*aggregates)


class Moments:
    """Count, mean vector and centred cross-product matrix of features followed by the target."""

    def __init__(self, columns: Sequence[str], n: int, mean: np.ndarray, cross: np.ndarray):
        self.columns, self.n, self.mean, self.cross = list(columns), n, mean, cross

    @classmethod
    def from_row(cls, row: Row, columns: Sequence[str]) -> "Moments":
        p = len(columns)
        if not row["n"]:
            return cls(columns, 0, np.zeros(p), np.zeros((p, p)))
        mean = np.array([row[f"mean_{c}"] for c in columns], dtype=float)
        cross = np.zeros((p, p))
        for i, a in enumerate(columns):
            for j in range(i, p):
                cross[i, j] = cross[j, i] = row[f"s_{a}_{columns[j]}"]
        return cls(columns, row["n"], mean, cross)

    def merge(self, other: "Moments") -> "Moments":
        n = self.n + other.n
        if n == 0:
            return self
        gap = other.mean - self.mean
        cross = self.cross + other.cross + np.outer(gap, gap) * (self.n * other.n / n)
        return Moments(self.columns, n, self.mean + gap * (other.n / n), cross)

    def solve(self, features: Sequence[str], alpha: float) -> dict[str, float]:
        """Ridge weights with an unpenalised intercept; alpha 0 is least squares."""
        if self.n == 0:
            raise ValueError("no complete rows to fit")
        at = [self.columns.index(f) for f in features]
        gram = self.cross[np.ix_(at, at)] + alpha * np.eye(len(at))
        right = self.cross[at, -1]
        if alpha > 0:
            weights = np.linalg.solve(gram, right)
        else:
            weights = np.linalg.lstsq(gram, right, rcond=None)[0]
        intercept = float(self.mean[-1] - weights @ self.mean[at])
        return {"intercept": intercept, **{f: float(w) for f, w in zip(features, weights)}}


def moments(df: DataFrame, features: Sequence[str], target: str) -> Moments:
    """The sufficient statistics on the driver (p-by-p numbers)."""
    return Moments.from_row(sufficient_statistics(df, features, target).first(), [*features, target])


def ridge_weights(df: DataFrame, features: Sequence[str], target: str, alpha: float) -> dict[str, float]:
    """Intercept and weights of one ridge fit."""
    return moments(df, features, target).solve(features, alpha)


def fit_ridge(df: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0, model: str = "ridge") -> DataFrame:
    """Ridge fit as registry rows ``(model, term, weight)``."""
    return registry_frame(df.sparkSession, {model: ridge_weights(df, features, target, alpha)})


def normal_equations(df: DataFrame, features: Sequence[str], target: str, weights: Mapping[str, float], alpha: float) -> DataFrame:
    """What the data say the fitted weights solve: per term ``cov(x, prediction) + alpha * weight / n``.

    For a ridge fit of these rows this equals ``cov(x, target)``, and the intercept's mean prediction equals the
    mean target; both can be had from the data without a solve.
    """
    rows = require_complete(df, [*features, target])
    predicted = linear_score(weights["intercept"], {f: weights[f] for f in features})
    x = {f: F.col(f).cast("double") for f in features}
    terms = [F.struct(F.lit("intercept").alias("term"), F.avg(predicted).alias("value"))]
    terms += [
        F.struct(F.lit(f).alias("term"), (F.covar_pop(x[f], predicted) + float(alpha) * weights[f] / F.count("*")).alias("value")) for f in features
    ]
    return rows.agg(F.array(*terms).alias("terms")).select(F.inline("terms"))


def fit_ols_sets(df: DataFrame, feature_sets: Mapping[str, Sequence[str]], target: str) -> dict[str, dict[str, float]]:
    """Least-squares fits of several (nested) feature sets from one pass over their union."""
    union = list(dict.fromkeys(f for fs in feature_sets.values() for f in fs))
    stats = moments(df, union, target)
    return {name: stats.solve(list(fs), 0.0) for name, fs in feature_sets.items()}


def fit_ols(df: DataFrame, feature_sets: Mapping[str, Sequence[str]], target: str) -> DataFrame:
    """Fit every set and report MAE, RMSE and R2 of each over the same complete rows."""
    union = list(dict.fromkeys(f for fs in feature_sets.values() for f in fs))
    rows = require_complete(df, [*union, target])
    scored = score_models(rows.select(*union, target), fit_ols_sets(df, feature_sets, target))
    return evaluate(scored, target, "pred", keys=("model",), with_r2=True)


def fit_offset_weight(
    df: DataFrame, x: str, y: str, offset: float = 2.5, bounds: tuple[float, float] | None = None
) -> DataFrame:
    """Weight minimising the squared error of ``-offset - w * x`` and its error figures.

    The objective is a parabola in w, so the optimum is a ratio of two sums, clipped to the bounds; the
    errors at the optimum follow from the same sums except the MAE, which needs the second pass.
    """
    rows = require_complete(df, [x, y])
    xv, yv = F.col(x).cast("double"), F.col(y).cast("double")
    best = F.try_divide(-F.sum(xv * (yv + float(offset))), F.sum(xv * xv))
    if bounds is not None:
        best = F.greatest(F.lit(float(bounds[0])), F.least(F.lit(float(bounds[1])), best))
    w = rows.agg(best.alias("w")).first()["w"]
    error = yv - (F.lit(-float(offset)) - F.lit(w).cast("double") * xv)
    return rows.agg(
        F.lit(w).cast("double").alias("weight"),
        F.count("*").alias("n_games"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
    )


def fit_residual_model(
    df: DataFrame, base_prediction: str, target: str, features: Sequence[str], alpha: float = 10.0
) -> tuple[dict[str, float], DataFrame]:
    """Ridge on what a base prediction leaves over; returns the weights and the corrected predictions."""
    residual = df.withColumn("residual", F.col(target) - F.col(base_prediction))
    weights = ridge_weights(residual, features, "residual", alpha)
    correction = linear_score(weights["intercept"], {f: weights[f] for f in features})
    corrected = residual.withColumn("correction", correction).withColumn(
        "pred", F.col(base_prediction) + F.col("correction")
    )
    return weights, corrected


def time_blocks(df: DataFrame, k: int, coarse: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Block 0 (the first training rows) and k equal later blocks in time order: ``n // (k + 1)`` rows each."""
    placed = global_position(df, coarse, order, "__pos", "__n")
    size = F.floor(F.col("__n") / F.lit(k + 1))
    first = F.col("__n") - size * k
    block = F.when(F.col("__pos") < first, F.lit(0)).otherwise(F.floor(F.try_divide(F.col("__pos") - first, size)) + 1)
    return placed.withColumn("block", block.cast("int")).drop("__pos", "__n")


def cv_ridge_time(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    alphas: Sequence[float] = ALPHAS,
    k: int = 5,
    coarse: Sequence[str] = ("season", "week", "gameday"),
    order: Sequence[str] = ("game_id",),
) -> DataFrame:
    """Mean absolute error of ridge per penalty over ``k`` expanding time splits.

    One pass gives the moments of every block; adding them up gives every training set, and the
    penalty enters only the small solves.  A second pass scores the k x penalties coefficient sets.
    """
    rows = require_complete(df, [*features, target]).select(*dict.fromkeys([*features, target, *coarse, *order]))
    blocks = time_blocks(rows, k, coarse, order)
    columns = [*features, target]
    per_block = {
        r["block"]: Moments.from_row(r, columns)
        for r in sufficient_statistics(blocks, features, target, by=["block"]).collect()
    }
    train = per_block[0]
    fits = []
    for fold in range(1, k + 1):
        for alpha in alphas:
            w = train.solve(features, alpha)
            fits.append((fold, float(alpha), w["intercept"], *[w[f] for f in features]))
        train = train.merge(per_block[fold])
    schema = "block int, alpha double, w_intercept double, " + ", ".join(f"w_{i} double" for i in range(len(features)))
    coefficients = F.broadcast(df.sparkSession.createDataFrame(fits, schema))
    pred = F.col("w_intercept")
    for i, f in enumerate(features):
        pred = pred + F.col(f) * F.col(f"w_{i}")
    scored = blocks.join(coefficients, "block").groupBy("block", "alpha").agg(
        F.avg(F.abs(F.col(target) - pred)).alias("mae")
    )
    return scored.groupBy("alpha").agg(F.avg("mae").alias("cv_mae"), F.count("*").alias("folds"))


def best_alpha(cv: DataFrame) -> float:
    """Penalty with the smallest error; the smaller penalty on a tie."""
    return cv.orderBy("cv_mae", "alpha").first()["alpha"]


def holdout_evaluate(
    df: DataFrame, target: str, pred: str, cutoff: int, season: str = "season", keys: Sequence[str] = ()
) -> DataFrame:
    """MAE, RMSE and R2 on either side of the cutoff season, for each of ``keys``."""
    split = df.withColumn("data_split", season_split(cutoff, season))
    return evaluate(split, target, pred, keys=(*keys, "data_split"), with_r2=True)


def residual_std(df: DataFrame, value: str = "edge", split: str = "data_split") -> DataFrame:
    """Population deviation of the edges per split."""
    return df.groupBy(split).agg(F.stddev_pop(value).alias("residual_std"), F.count(value).alias("n"))
