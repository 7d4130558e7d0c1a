"""Strictly-past rolling form, rest, recent games and leak audits.

Every frame ends one row before the current one.  Windows follow a team across seasons in a stated
total order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hashmark.functions.missing import first_type_or
from hashmark.operators.reshape import GAME, fold_sides, to_team_games, with_game
from hashmark.operators.scale import drop_carried, history_window, running_total, split_histories

GAME_ORDER = ["season", "week", "gameday", "game_id"]
GAME_COARSE = ["season", "week", "gameday"]
FORM_SOURCES = {
    "offense_form_epa": "off_epa_per_play",
    "offense_form_success": "off_success_rate",
    "defense_form_epa": "def_epa_per_play",
    "defense_form_success": "def_success_rate",
}
OFFENSE_FORM = ("offense_form_epa", "offense_form_success")
DEFENSE_FORM = ("defense_form_epa", "defense_form_success")


def _form(df: DataFrame, names: Sequence[str], window: int, keep: Sequence[str]) -> DataFrame:
    # one row per (team, season, week): a team's history is as long as the calendar, never longer
    past = Window.partitionBy("team").orderBy("season", "week").rowsBetween(-window, -1)
    sources = {n: FORM_SOURCES[n] for n in names}
    prepared = df.select("team", "season", "week", *keep, *[first_type_or(df, s, "double") for s in sources.values()])
    return prepared.withColumns({n: F.avg(s).over(past) for n, s in sources.items()}).select(
        "team", "season", "week", *keep, *names
    )


def offense_form(df: DataFrame, window: int = 4, keep: Sequence[str] = ()) -> DataFrame:
    """Mean offence EPA and success over the last ``window`` periods; a missing column gives NULL form."""
    return _form(df, OFFENSE_FORM, window, keep)


def defense_form(df: DataFrame, window: int = 4, keep: Sequence[str] = ()) -> DataFrame:
    """The same for the defence."""
    return _form(df, DEFENSE_FORM, window, keep)


def team_form(df: DataFrame, window: int = 4, keep: Sequence[str] = ()) -> DataFrame:
    """Offence and defence form over one shared window: one shuffle, one sort, no join."""
    return _form(df, OFFENSE_FORM + DEFENSE_FORM, window, keep)


def rolling_multi(
    df: DataFrame,
    columns: Mapping[str, str],
    windows: Sequence[int] = (3, 5, 10),
    margin: tuple[str, str, str] | None = None,
    keys: Sequence[str] = ("team",),
    order: Sequence[str] = ("season", "week"),
    coarse: Sequence[str] | None = None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Rolling means ``{name}_L{n}`` of several columns and widths over one partitioning.

    A table with one row per key and period needs no cutting; for others ``chunk_rows`` cuts histories
    between values of ``coarse``.  ``margin=(name, a, b)`` adds ``{name}_L{n} = {a}_L{n} - {b}_L{n}``.
    """
    plain = Window.partitionBy(*keys).orderBy(*order)
    split = df if chunk_rows is None else split_histories(df, keys, order, max(windows), coarse or order, chunk_rows)
    base = plain if chunk_rows is None else history_window(keys, order)
    out = split.withColumns({
        f"{name}_L{n}": F.avg(source).over(base.rowsBetween(-n, -1)) for n in windows for name, source in columns.items()
    })
    out = out if chunk_rows is None else drop_carried(out)
    if margin:
        name, a, b = margin
        out = out.withColumns({f"{name}_L{n}": F.col(f"{a}_L{n}") - F.col(f"{b}_L{n}") for n in windows})
    return out


def recent_form(
    games: DataFrame, windows: Sequence[int] = (3, 5), line: str | None = "home_line", chunk_rows: int | None = None
) -> DataFrame:
    """Per team-game: win rate, cover rate and mean difference of the past games, and wins in the last five.

    A team's history is cut at seasons, or where ``chunk_rows`` rows are counted.
    """
    long = to_team_games(games, line=line)
    split = split_games(long, max(*windows, 5), chunk_rows)
    base = history_window(["team"], GAME_ORDER)
    out = {"last_5_wins": F.sum("win").over(base.rowsBetween(-5, -1))}
    for n in windows:
        frame = base.rowsBetween(-n, -1)
        out |= {
            f"win_rate_L{n}": F.avg("win").over(frame),
            f"ats_rate_L{n}": F.avg("ats_cover").over(frame),
            f"point_diff_L{n}": F.avg("point_diff").over(frame),
        }
    return drop_carried(split.withColumns(out))


def split_games(long: DataFrame, carry: int, chunk_rows: int | None, light: Sequence[str] = ()) -> DataFrame:
    """Team-games with their histories cut at seasons, or where ``chunk_rows`` rows are counted."""
    if chunk_rows is None:
        return split_histories(long, ["team"], GAME_ORDER, carry, GAME_COARSE, cut=F.col("season"), light=light)
    return split_histories(long, ["team"], GAME_ORDER, carry, GAME_COARSE, chunk_rows, light=light)


def team_rest(games: DataFrame, date: str = "gameday", chunk_rows: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Days since the team's previous game, one row per (game, side).  Of ``keep`` the home row has the values."""
    long = games.select(
        "game_id", "season", "week", F.col(date).alias("gameday"), *[k for k in keep],
        F.inline(
            F.array(
                F.struct(F.col("home_team").alias("team"), F.lit(True).alias("is_home")),
                F.struct(F.col("away_team").alias("team"), F.lit(False).alias("is_home")),
            )
        ),
    )
    long = _on_home_row(long, keep)
    order = ["gameday", "game_id"]
    if chunk_rows is None:
        split = split_histories(long, ["team"], order, 1, ["gameday"], cut=F.year("gameday"), light=keep)
    else:
        split = split_histories(long, ["team"], order, 1, ["gameday"], chunk_rows, light=keep)
    previous = F.lag("gameday").over(history_window(["team"], order))
    return drop_carried(split.withColumn("rest_days", F.datediff(F.col("gameday"), previous)))


def _on_home_row(long: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The game is carried by one of its two rows only; both keep the hash that brings them together."""
    return long.withColumn("__game", F.when(F.col("is_home"), F.col("__game"))) if "__game" in keep else long


def attach_rest(games: DataFrame, rest: DataFrame, key: str = "game_id") -> DataFrame:
    """Put both sides' rest, from any frame that has it, on the game row and add the advantage (a missing rest counts 0).

    ``rest`` is folded to one narrow row per game first; the fold and the join share one partitioning.
    """
    folded = rest.groupBy(key).agg(
        F.max(F.when(F.col("is_home"), F.col("rest_days"))).alias("home_rest_days"),
        F.max(F.when(~F.col("is_home"), F.col("rest_days"))).alias("away_rest_days"),
    )
    return _with_advantage(games.join(folded, key, "left"), "home_rest_days", "away_rest_days")


def _with_advantage(games: DataFrame, home: str, away: str) -> DataFrame:
    return games.withColumn("rest_advantage", F.coalesce(home, F.lit(0)) - F.coalesce(away, F.lit(0)))


def rest_days(games: DataFrame, date: str = "gameday", chunk_rows: int | None = None) -> DataFrame:
    """Games with home and away rest and the rest advantage; every team counts, hosting or not.

    The game travels with its home row: one exchange by team, one by game, no join.
    """
    rest = team_rest(with_game(games), date, chunk_rows, keep=GAME)
    return _with_advantage(fold_sides(rest, {"rest_days": "{side}_rest_days"}), "home_rest_days", "away_rest_days")


def cumulative_ev(
    df: DataFrame,
    value: str = "ev_dollars",
    keys: Sequence[str] = ("model",),
    coarse: Sequence[str] = ("season", "week", "gameday"),
    order: Sequence[str] = ("game_id",),
) -> DataFrame:
    """Running expected value per model in game order."""
    return running_total(df, keys, coarse, order, value, "cumulative_ev")


def _played(long: DataFrame) -> DataFrame:
    return long.filter(F.col("points_for").isNotNull() & F.col("points_against").isNotNull())


def entity_record(long: DataFrame, season: int | None = None, through: int | None = None) -> DataFrame:
    """Record of every team over its played games, up to a week of a season if given."""
    rows = _played(long)
    if season is not None:
        rows = rows.filter(F.col("season") == season)
    if through is not None:
        rows = rows.filter(F.col("week") <= through)
    won, lost = F.col("points_for") > F.col("points_against"), F.col("points_for") < F.col("points_against")
    return rows.groupBy("team").agg(
        F.count("*").alias("games_played"),
        F.count_if(won).alias("wins"),
        F.count_if(lost).alias("losses"),
        F.count_if(~won & ~lost).alias("ties"),
        F.avg("points_for").alias("ppg"),
        F.avg("points_against").alias("ppg_allowed"),
        F.avg("point_diff").alias("margin"),
    )


def last_n_summary(long: DataFrame, n: int = 5, season: int | None = None, through: int | None = None) -> DataFrame:
    """Wins and mean margin over each team's last ``n`` played games.

    The rank filter is pushed below the shuffle by Spark, so at most ``n`` rows per team and task move.
    """
    rows = _played(long)
    if season is not None:
        rows = rows.filter(F.col("season") == season)
    if through is not None:
        rows = rows.filter(F.col("week") <= through)
    newest = Window.partitionBy("team").orderBy(*[F.col(c).desc() for c in GAME_ORDER])
    return (
        rows.withColumn("__r", F.row_number().over(newest))
        .filter(F.col("__r") <= n)
        .groupBy("team")
        .agg(F.sum("win").alias(f"last_{n}_wins"), F.avg("point_diff").alias(f"last_{n}_margin"))
    )


def head_to_head(games: DataFrame, n: int = 10) -> DataFrame:
    """The newest ``n`` meetings of every unordered pair."""
    pairs = games.withColumns({
        "side_a": F.least("home_team", "away_team"),
        "side_b": F.greatest("home_team", "away_team"),
    })
    newest = Window.partitionBy("side_a", "side_b").orderBy(F.col("gameday").desc(), F.col("game_id").desc())
    return pairs.withColumn("meeting", F.row_number().over(newest)).filter(F.col("meeting") <= n)


def head_to_head_summary(games: DataFrame, n: int = 10) -> DataFrame:
    """Meetings, wins of each side and mean total of the newest ``n`` meetings of every pair."""
    meetings = head_to_head(games, n)
    a_is_home = F.col("home_team") == F.col("side_a")
    a_points = F.when(a_is_home, F.col("home_score")).otherwise(F.col("away_score"))
    b_points = F.when(a_is_home, F.col("away_score")).otherwise(F.col("home_score"))
    return meetings.groupBy("side_a", "side_b").agg(
        F.count("*").alias("meetings"),
        F.count_if(a_points > b_points).alias("side_a_wins"),
        F.count_if(b_points > a_points).alias("side_b_wins"),
        F.avg(F.col("home_score") + F.col("away_score")).alias("mean_total"),
    )


def audit_leakage(
    df: DataFrame,
    feature: str,
    source: str,
    window: int,
    entity: str = "team",
    order: Sequence[str] = ("season", "week"),
    tolerance: float = 1e-9,
) -> DataFrame:
    """Recompute a rolling feature by a strictly-past equi-join and count the rows that differ.

    Each row is sent to the next ``window`` positions of its entity, so the join is an equality on
    (entity, position): no pairs are enumerated within an entity.  ``df`` must be at entity-period grain.
    """
    positions = df.withColumn("__p", F.row_number().over(Window.partitionBy(entity).orderBy(*order)))
    sent = positions.select(
        entity, F.explode(F.sequence(F.col("__p") + 1, F.col("__p") + window)).alias("__p"), F.col(source).alias("__x")
    )
    honest = sent.groupBy(entity, "__p").agg(F.avg("__x").alias("__honest"))
    compared = positions.join(honest, [entity, "__p"], "left")
    differs = ~F.coalesce(
        F.abs(F.col(feature) - F.col("__honest")) <= tolerance,
        F.col(feature).isNull() & F.col("__honest").isNull(),
    )
    return compared.agg(
        F.lit(feature).alias("feature"),
        F.count("*").alias("rows_checked"),
        F.count_if(differs).alias("rows_leaking"),
    )


def leakage_alarm(df: DataFrame, target: str, features: Sequence[str], limit: float = 0.95) -> DataFrame:
    """Squared correlation of each feature with the target; an alarm above the limit."""
    row = df.agg(*[F.corr(f, target).alias(f) for f in features])
    long = row.select(
        F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), (F.col(f) * F.col(f)).alias("r_squared")) for f in features]))
    )
    return long.withColumn("alarm", F.coalesce(F.col("r_squared") > limit, F.lit(False)))
