"""Team-game long tables, set operations, deduplication and period upserts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hashmark.operators.scale import join_back


def to_team_games(
    games: DataFrame,
    home: str = "home_team",
    away: str = "away_team",
    home_score: str = "home_score",
    away_score: str = "away_score",
    line: str | None = "home_line",
    keep: Sequence[str] = ("game_id", "season", "week", "gameday"),
) -> DataFrame:
    """Each game as a home row and an away row, from one scan.

    Win, cover and difference are NULL for an unplayed game; a missing line gives a NULL cover.
    """
    margin = F.col(home_score) - F.col(away_score)
    cover = margin + F.col(line) if line else F.lit(None).cast("double")

    def side(team: str, opponent: str, location: str, sign: int):
        diff = margin if sign > 0 else F.negative(margin)
        covered = (cover > 0).cast("int")
        return F.struct(
            F.col(team).alias("team"),
            F.col(opponent).alias("opponent"),
            F.lit(location).alias("location"),
            F.lit(sign > 0).alias("is_home"),
            F.col(home_score if sign > 0 else away_score).alias("points_for"),
            F.col(away_score if sign > 0 else home_score).alias("points_against"),
            (diff > 0).cast("int").alias("win"),
            (covered if sign > 0 else F.lit(1) - covered).alias("ats_cover"),
            diff.alias("point_diff"),
        )

    return games.select(
        *keep, F.inline(F.array(side(home, away, "home", 1), side(away, home, "away", -1)))
    )


#: What a long row carries of its game, to be folded back by ``fold_sides``.
GAME = ("__game", "__row")


def with_game(games: DataFrame) -> DataFrame:
    """Games with themselves as a struct and a hash of it, which tells rows of one key apart."""
    columns = [F.col(c) for c in games.columns]
    return games.withColumns({"__game": F.struct(*columns), "__row": F.xxhash64(*columns)})


def fold_sides(long: DataFrame, values: Mapping[str, str], key: str = "game_id") -> DataFrame:
    """The games that long rows carry, with both sides' values: one grouped aggregate instead of a join with the games.

    ``values`` names the output of each value by a pattern with ``{side}``.  A repeated game comes back as often as it was there.
    """
    home = F.col("is_home")
    sides = {pattern.format(side=side): F.max(F.when(home == is_home, F.col(v))) for v, pattern in values.items() for side, is_home in (("home", True), ("away", False))}
    folded = long.groupBy(key, "__row").agg(
        F.first("__game", ignorenulls=True).alias("__game"), F.count_if(home).alias("__copies"), *[c.alias(n) for n, c in sides.items()]
    )
    game = F.explode(F.array_repeat("__game", F.col("__copies").cast("int"))).alias("__game")
    return folded.select(game, *sides).select("__game.*", *sides)


def dedup_keep(df: DataFrame, keys: Sequence[str], order: Sequence, keep: str = "last") -> DataFrame:
    """First or last row per key in a stated total order.

    Spark limits each map task to one row per key before the shuffle, so a hot key costs nothing extra.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranked = Window.partitionBy(*keys).orderBy(*(cols if keep == "first" else [c.desc() for c in cols]))
    return df.withColumn("__r", F.row_number().over(ranked)).filter(F.col("__r") == 1).drop("__r")


def upsert_period(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows of ``new`` replace rows of ``existing`` with the same keys; within a side the last in ``order`` wins."""
    both = existing.withColumn("__side", F.lit(0)).unionByName(new.withColumn("__side", F.lit(1)))
    return dedup_keep(both, keys, ["__side", *order]).drop("__side")


def game_ratings_to_team(
    games: DataFrame, home_rating: str = "rating_home", away_rating: str = "rating_away", order: Sequence[str] = ("season", "week", "gameday", "game_id")
) -> DataFrame:
    """First rating per team in game order, from both sides of the games."""
    pairs = games.select(
        *order,
        F.inline(
            F.array(
                F.struct(F.col("home_team").alias("team"), F.col(home_rating).alias("rating"), F.lit(0).alias("side")),
                F.struct(F.col("away_team").alias("team"), F.col(away_rating).alias("rating"), F.lit(1).alias("side")),
            )
        ),
    )
    # a partial aggregate per map task: min of (order, side), carrying the rating
    first = F.min_by(F.col("rating"), F.struct(*[F.col(c) for c in order], F.col("side")))
    return pairs.filter(F.col("team").isNotNull()).groupBy("team").agg(first.alias("rating"))


def key_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``a`` that ``b`` does not have (NULL equals NULL)."""
    return join_back(a.select(*keys).distinct(), b.select(*keys), list(keys), "left_anti")


def matchups_from_games(games: DataFrame, line: str = "home_line") -> DataFrame:
    """Season, week, sides and closing line of every game."""
    return games.select("season", "week", "away_team", "home_team", F.col(line).alias("closing_line"))
