"""Linear fits over the structural dataset, checked against closed forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from hashmark.catalog.bindings import sql, team_week
from hashmark.catalog.games import _FORM_DIFFS, _FORM_JOIN, keyed
from hashmark.catalog.registry import query
from hashmark.catalog.reports import CUTOFF, dataset, scored, sized
from hashmark.operators import families, models
from hashmark.plans import datasets

X, Z, Y = "rating_diff", "qb_diff", "closing_spread"

# Closed form of ridge with two features, from centred sums.
_SUMS = f"""SELECT count(*) AS n, avg({X}) AS mx, avg({Z}) AS mz, avg({Y}) AS my, covar_pop({X}, {X}) * count(*) AS sxx, covar_pop({X}, {Z}) * count(*) AS sxz,
  covar_pop({Z}, {Z}) * count(*) AS szz, covar_pop({X}, {Y}) * count(*) AS sxy, covar_pop({Z}, {Y}) * count(*) AS szy"""


def _two_feature_weights(alpha: str) -> str:
    det = f"((sxx + {alpha}) * (szz + {alpha}) - sxz * sxz)"
    return f"((szz + {alpha}) * sxy - sxz * szy) / {det} AS wx, ((sxx + {alpha}) * szy - sxz * sxy) / {det} AS wz"


@query(
    "sufficient_statistics",
    sql(
        f"""SELECT count(*) AS n, avg({X}) AS mean_{X}, avg({Z}) AS mean_{Z}, avg({Y}) AS mean_{Y}, covar_pop({X}, {X}) * count(*) AS s_{X}_{X}, covar_pop({X}, {Z}) * count(*) AS s_{X}_{Z},
        covar_pop({X}, {Y}) * count(*) AS s_{X}_{Y}, covar_pop({Z}, {Z}) * count(*) AS s_{Z}_{Z}, covar_pop({Z}, {Y}) * count(*) AS s_{Z}_{Y}, covar_pop({Y}, {Y}) * count(*) AS s_{Y}_{Y} FROM DS""",
        "DS",
    ),
    f"mean_{X} mean_{Z} mean_{Y} s_{X}_{X} s_{X}_{Z} s_{X}_{Y} s_{Z}_{Z} s_{Z}_{Y} s_{Y}_{Y}", 2,
)
def _(spark, sf_dir):
    return models.sufficient_statistics(dataset(spark, sf_dir), [X, Z], Y)


@query(
    "fit_ridge",
    sql(
        f"""SELECT 'ridge' AS model, unnest(['intercept', '{X}', '{Z}']) AS term, unnest([my - wx * mx - wz * mz, wx, wz]) AS weight
        FROM (SELECT *, {_two_feature_weights('100.0::double')} FROM ({_SUMS} FROM DS WHERE season < {CUTOFF}))""",
        "DS",
    ),
    "weight", 9,
)
def _(spark, sf_dir):
    return models.fit_ridge(dataset(spark, sf_dir).filter(F.col("season") < CUTOFF), [X, Z], Y, alpha=100.0)


@query(
    "fit_ols",
    sql(
        f"""SELECT model, avg(abs({Y} - p)) AS mae, sqrt(avg(({Y} - p) * ({Y} - p))) AS rmse, count(*) AS n_games, 1 - sum(({Y} - p) * ({Y} - p)) / (count(*) * var_pop({Y})) AS r2 FROM (
        SELECT 'one' AS model, {Y}, my + slope * ({X} - mx) AS p FROM DS, (SELECT avg({Y}) AS my, avg({X}) AS mx, regr_slope({Y}, {X}) AS slope FROM DS)
        UNION ALL SELECT 'two', {Y}, my + wx * ({X} - mx) + wz * ({Z} - mz) FROM DS, (SELECT *, {_two_feature_weights('0')} FROM ({_SUMS} FROM DS))) GROUP BY model""",
        "DS",
    ),
    "mae rmse r2",
)
def _(spark, sf_dir):
    return models.fit_ols(dataset(spark, sf_dir), {"one": [X], "two": [X, Z]}, Y)


@query(
    "fit_offset_weight",
    sql(
        f"""SELECT w AS weight, count(*) AS n_games, avg(abs({Y} + 2.5 + w * {X})) AS mae, sqrt(avg(({Y} + 2.5 + w * {X}) * ({Y} + 2.5 + w * {X}))) AS rmse
        FROM DS, (SELECT greatest(0.0, least(0.5, -sum({X} * ({Y} + 2.5)) / sum({X} * {X}))) AS w FROM DS) GROUP BY w""",
        "DS",
    ),
    "weight mae rmse",
)
def _(spark, sf_dir):
    return models.fit_offset_weight(dataset(spark, sf_dir), X, Y, 2.5, (0.0, 0.5))


@query(
    "fit_residual_model",
    sql(
        f"""SELECT game_id, -2.5 - 0.02::double * {X} AS base, my + wx * (rest_advantage - mx) + wz * ({Z} - mz) AS correction,
        -2.5 - 0.02::double * {X} + my + wx * (rest_advantage - mx) + wz * ({Z} - mz) AS pred FROM DS, (
          SELECT *, {_two_feature_weights('10.0::double')} FROM (
            SELECT avg(x) AS mx, avg(z) AS mz, avg(y) AS my, covar_pop(x, x) * count(*) AS sxx, covar_pop(x, z) * count(*) AS sxz, covar_pop(z, z) * count(*) AS szz,
              covar_pop(x, y) * count(*) AS sxy, covar_pop(z, y) * count(*) AS szy FROM (
              SELECT rest_advantage AS x, {Z} AS z, {Y} - (-2.5 - 0.02::double * {X}) AS y FROM DS)))""",
        "DS",
    ),
    "base correction pred",
)
def _(spark, sf_dir):
    """The correction uses the columns of the structural families: here rest and passer difference."""
    rows = dataset(spark, sf_dir).withColumn("base", F.lit(-2.5) - F.col(X) * 0.02)
    features = families.family_columns(rows)
    _, corrected = models.fit_residual_model(rows, "base", Y, features, alpha=10.0)
    return corrected.select("game_id", "base", "correction", "pred")


_ALPHAS = "(SELECT unnest([0.01, 0.1, 1.0, 10.0, 100.0])::double AS alpha)"


@query(
    "cv_ridge_time",
    sql(
        f""", B AS (SELECT {X}, {Z}, {Y}, CASE WHEN pos < n - 5 * (n // 6) THEN 0 ELSE 1 + (pos - (n - 5 * (n // 6))) // (n // 6) END AS block FROM (
          SELECT *, row_number() OVER (ORDER BY season, week, game_id) - 1 AS pos, count(*) OVER () AS n FROM DS)),
        T AS (SELECT fold, s.* FROM (SELECT unnest([1, 2, 3, 4, 5]) AS fold) f, LATERAL ({_SUMS} FROM B WHERE block < f.fold) s),
        W AS (SELECT fold, alpha, mx, mz, my, {_two_feature_weights('alpha')} FROM T, {_ALPHAS})
        SELECT alpha, avg(mae) AS cv_mae, count(*) AS folds FROM (
          SELECT fold, alpha, avg(abs({Y} - (my + wx * ({X} - mx) + wz * ({Z} - mz)))) AS mae FROM W JOIN B ON B.block = W.fold GROUP BY fold, alpha) GROUP BY alpha""",
        "DS",
    ).replace(") , B AS", "), B AS"),
    "cv_mae",
)
def _(spark, sf_dir):
    return models.cv_ridge_time(dataset(spark, sf_dir), [X, Z], Y, coarse=["season", "week"])


@query(
    "time_blocks",
    sql(
        """SELECT game_id, CAST(CASE WHEN pos < n - 5 * (n // 6) THEN 0 ELSE 1 + (pos - (n - 5 * (n // 6))) // (n // 6) END AS INTEGER) AS block FROM (
          SELECT *, row_number() OVER (ORDER BY season, week, game_id) - 1 AS pos, count(*) OVER () AS n FROM DS)""",
        "DS",
    ),
)
def _(spark, sf_dir):
    rows = dataset(spark, sf_dir).select("game_id", "season", "week")
    return models.time_blocks(rows, 5, ["season", "week"], ["game_id"]).select("game_id", "block")


@query(
    "holdout_evaluate",
    sql(
        f"""SELECT model, CASE WHEN season < {CUTOFF} THEN 'train' ELSE 'test' END AS data_split, avg(abs_edge) AS mae, sqrt(avg(edge * edge)) AS rmse, count(*) AS n_games,
        1 - sum(edge * edge) / (count(*) * var_pop({Y})) AS r2 FROM SC GROUP BY 1, 2""",
        "SC",
    ),
    "mae rmse r2",
)
def _(spark, sf_dir):
    return models.holdout_evaluate(scored(spark, sf_dir), Y, "pred", CUTOFF, keys=["model"])


@query(
    "residual_std",
    sql("SELECT data_split, stddev_pop(edge) AS residual_std, count(edge) AS n FROM SB GROUP BY data_split", "SB"),
    "residual_std",
)
def _(spark, sf_dir):
    return models.residual_std(sized(spark, sf_dir))


_FORM_TERMS = datasets.STRUCTURAL_FEATURES + datasets.FORM_FEATURES


@query(
    "fit_form_model",
    sql(
        f"""SELECT unnest(['intercept', {", ".join(f"'{t}'" for t in _FORM_TERMS)}]) AS term, unnest([avg({Y}), {", ".join(f"covar_pop({t}, {Y})" for t in _FORM_TERMS)}]) AS value
        FROM (SELECT g.*, {_FORM_DIFFS} FROM DS g {_FORM_JOIN}) WHERE season < {CUTOFF} AND {" AND ".join(f"{t} IS NOT NULL" for t in (*_FORM_TERMS, Y))}""",
        "DS", "FORM",
    ),
    "value",
)
def _(spark, sf_dir):
    """Plays to form to ridge on ten features; the fitted weights are put into the normal equations of the data."""
    rows = datasets.form_dataset(keyed(spark, sf_dir), team_week(spark, sf_dir), key="game_key")
    weights = {r["term"]: r["weight"] for r in datasets.fit_form_model(rows, CUTOFF).collect()}
    return models.normal_equations(rows.filter(F.col("season") < CUTOFF), _FORM_TERMS, Y, weights, 1.0)
