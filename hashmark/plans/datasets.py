"""Training frames and the per-team feature frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashmark.functions.missing import fill_defaults, first_type_or, require_complete
from hashmark.functions.scoring import rest_from_modifiers, side_differences
from hashmark.operators.joins import attach_weekly_stats, join_form_both_sides, matchup_features
from hashmark.operators.models import fit_ridge
from hashmark.operators.periods import team_period_stats
from hashmark.operators.reshape import GAME, fold_sides, to_team_games, with_game
from hashmark.operators.scale import drop_carried, history_window
from hashmark.operators.windows import GAME_ORDER, split_games, team_form
from hashmark.sources.tables import select_rated_games

# Fixed column lists of the two training frames; the last three columns repeat outcomes on purpose, as
# canaries for leak checks.
LEAK_CANARIES = ("home_points", "away_points", "home_margin")
BASE_COLUMNS = (
    "game_id", "season", "week", "away_team", "home_team", "rating_diff", "closing_spread",
    "home_score", "away_score", "actual_margin", *LEAK_CANARIES,
)
STRUCTURAL_FEATURES = ("rating_diff", "rest_advantage", "div_game", "surface_mod", "time_advantage", "qb_diff")
STRUCTURAL_COLUMNS = (
    "game_id", "season", "week", "away_team", "home_team", *STRUCTURAL_FEATURES, "closing_spread",
    "home_score", "away_score", "actual_margin", *LEAK_CANARIES,
)
FORM_FEATURES = (
    "offense_form_epa_diff", "offense_form_success_diff", "defense_form_epa_diff", "defense_form_success_diff",
)
MODIFIERS = {"div_game": "div_game_mod", "surface_mod": "dif_surface_mod", "time_advantage": "home_time_advantage_mod"}


def _outcomes(df: DataFrame) -> DataFrame:
    """Scores, margin and canaries; NULL where the game has not been played or there are no scores."""
    scored = df.withColumns({c: first_type_or(df, c, "double").cast("double") for c in ("home_score", "away_score")})
    return scored.withColumn("actual_margin", F.col("home_score") - F.col("away_score")).withColumns({
        "home_points": F.col("home_score"), "away_points": F.col("away_score"), "home_margin": F.col("actual_margin"),
    })


def base_dataset(rated: DataFrame, start: int | None = None, end: int | None = None, key: str | None = "game_id") -> DataFrame:
    """The 13-column frame: rating difference against the closing spread.  ``key`` names the game key, if it must be parsed."""
    games = select_rated_games(rated, start, end, key=key)
    diffs = side_differences(games, {"rating_diff": ("rating_home", "rating_away")})
    return _outcomes(diffs.withColumn("closing_spread", F.col("home_line"))).select(*BASE_COLUMNS)


def structural_dataset(rated: DataFrame, start: int | None = None, end: int | None = None, key: str | None = "game_id") -> DataFrame:
    """The 18-column frame: rating, rest, division, surface, time zone and passer differences."""
    games = rest_from_modifiers(select_rated_games(rated, start, end, key=key))
    diffs = side_differences(games, {"rating_diff": ("rating_home", "rating_away")})
    zero = F.lit(0.0)
    typed = diffs.withColumns({
        **{name: F.coalesce(first_type_or(diffs, source, "double").cast("double"), zero) for name, source in MODIFIERS.items()},
        "qb_diff": F.coalesce(first_type_or(diffs, "home_qb_adj", "double").cast("double"), zero)
        - F.coalesce(first_type_or(diffs, "away_qb_adj", "double").cast("double"), zero),
        "closing_spread": F.col("home_line"),
    })
    complete = require_complete(_outcomes(typed), [*STRUCTURAL_FEATURES, "closing_spread"])
    return complete.select(*STRUCTURAL_COLUMNS)


def form_dataset(
    rated: DataFrame, team_week: DataFrame, window: int = 4, start: int | None = None, end: int | None = None, key: str | None = "game_id"
) -> DataFrame:
    """The structural frame with the four form differences; early games keep NULL form."""
    return join_form_both_sides(structural_dataset(rated, start, end, key), team_form(team_week, window))


def fit_form_model(
    dataset: DataFrame, cutoff: int, alpha: float = 1.0, features: Sequence[str] = STRUCTURAL_FEATURES + FORM_FEATURES,
    target: str = "closing_spread", model: str = "form",
) -> DataFrame:
    """Ridge on the complete games before the cutoff season."""
    return fit_ridge(dataset.filter(F.col("season") < cutoff), features, target, alpha, model)


def rolling_team_form(plays: DataFrame, window: int = 4) -> DataFrame:
    """Plays to leak-free team form, end to end."""
    return team_form(team_period_stats(plays), window)


def team_feature_frame(
    games: DataFrame,
    stats: DataFrame | None = None,
    ratings: DataFrame | None = None,
    windows: Sequence[int] = (3, 5, 10),
    form_windows: Sequence[int] = (3, 5),
    columns: Mapping[str, str] | None = None,
    line: str | None = "home_line",
    chunk_rows: int | None = None,
) -> DataFrame:
    """Games with rest, rolling statistics, recent form and rating matchups for both sides.

    One long table, one shuffle by team and one sort serve every frame; the game travels with its home row, so that one
    fold by game brings both sides' features back to it.
    """
    long = to_team_games(with_game(games), line=line, keep=("game_id", "season", "week", "gameday", *GAME))
    long = long.withColumn("__game", F.when(F.col("is_home"), F.col("__game")))
    columns = dict(columns or {"epa_off": "off_epa_per_play", "epa_def": "def_epa_per_play"})
    sources = list(columns.values())
    if stats is not None:
        long = attach_weekly_stats(long, stats.select("season", "week", "team", *sources))
    split = split_games(long, max(*windows, *form_windows, 5), chunk_rows, light=GAME)
    base = history_window(["team"], GAME_ORDER)
    features = {
        "rest_days": F.datediff(F.col("gameday"), F.lag("gameday").over(base)),
        "last_5_wins": F.sum("win").over(base.rowsBetween(-5, -1)),
    }
    for n in form_windows:
        frame = base.rowsBetween(-n, -1)
        features |= {
            f"win_rate_L{n}": F.avg("win").over(frame),
            f"ats_rate_L{n}": F.avg("ats_cover").over(frame),
            f"point_diff_L{n}": F.avg("point_diff").over(frame),
        }
    if stats is not None:
        for n in windows:
            features |= {f"{name}_L{n}": F.avg(source).over(base.rowsBetween(-n, -1)) for name, source in columns.items()}
    table = drop_carried(split.withColumns(features))
    out = fold_sides(table, {f: f"{f}_{{side}}" for f in features}).withColumn(
        "rest_advantage", F.coalesce("rest_days_home", F.lit(0)) - F.coalesce("rest_days_away", F.lit(0))
    )
    return matchup_features(out, ratings) if ratings is not None else out
