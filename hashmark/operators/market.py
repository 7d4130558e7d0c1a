"""Quotes: pricing columns, closing lines and closing-line value."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashmark.functions import pricing
from hashmark.operators.scale import AT, PART, in_ranges, join_back


def price_quotes(
    quotes: DataFrame,
    home_odds: str = "home_odds",
    away_odds: str = "away_odds",
    line: str = "line",
    model_line: str | None = None,
    sigma: float = 2.0,
    stake: float = 100.0,
    power: float = 2.0,
) -> DataFrame:
    """Every pricing column of a two-way quote, as expressions on the row.

    Unsuffixed value columns are the home side's.  The model's home probability comes from ``model_line`` (default: the quoted line) and ``sigma``.
    """
    h, a = F.col(home_odds), F.col(away_odds)
    # what several columns need is named first and computed once; written out in each, the row's code is too long to compile
    z = F.try_divide(F.negative(F.col(model_line or line)), F.lit(float(sigma)))
    staged = quotes.withColumn("__z", z).withColumn("__size", F.coalesce(F.abs("__z"), F.lit(0.0)))
    named = staged.withColumns({
        "__ih": pricing.implied_prob(h), "__ia": pricing.implied_prob(a), "__bh": pricing.net_payout(h), "__ba": pricing.net_payout(a),
        "home_win_prob": pricing.normal_cdf(F.col("__z"), F.col("__size")),
    })
    ih, ia, p = F.col("__ih"), F.col("__ia"), F.col("home_win_prob")
    shares = named.withColumns({
        "__sh": ih if power == 1.0 else F.pow(ih, F.lit(float(power))), "__sa": ia if power == 1.0 else F.pow(ia, F.lit(float(power))),
        "devig_mult_home": F.try_divide(ih, ih + ia), "devig_mult_away": F.try_divide(ia, ih + ia), "__lose": F.lit(1.0) - p,
    })
    sh, sa, lose = F.col("__sh"), F.col("__sa"), F.col("__lose")
    sided = shares.withColumns({
        "kelly_full": pricing.kelly_at(p, lose, F.col("__bh")), "kelly_full_away": pricing.kelly_at(lose, p, F.col("__ba")),
        "ev_dollars": pricing.ev_at(p, lose, F.col("__bh"), stake), "ev_dollars_away": pricing.ev_at(lose, p, F.col("__ba"), stake),
    })
    return sided.withColumns({
        "implied_prob_home": ih,
        "implied_prob_away": ia,
        "devig_power_home": F.try_divide(sh, sh + sa),
        "devig_power_away": F.try_divide(sa, sa + sh),
        "vig": ih + ia - 1.0,
        "break_even": ih,
        "fair_odds_home": pricing.fair_odds(F.col("devig_mult_home")),
        "ev_pct": pricing.ev_pct(p, F.col("devig_mult_home")),
        "kelly_quarter": F.col("kelly_full") * pricing.KELLY_SHARE,
        "fair_odds_away": pricing.fair_odds(F.col("devig_mult_away")),
        "ev_pct_away": pricing.ev_pct(lose, F.col("devig_mult_away")),
        "kelly_quarter_away": F.col("kelly_full_away") * pricing.KELLY_SHARE,
    }).drop("__z", "__size", "__ih", "__ia", "__bh", "__ba", "__sh", "__sa", "__lose")


def closing_quotes(
    quotes: DataFrame,
    kickoff: Column,
    game: str = "game_id",
    ts: str = "ts",
    tie_break: Sequence[str] = (),
    columns: Sequence[str] = ("line",),
) -> DataFrame:
    """Last quote of every game at or before kickoff.

    A maximum per game, combined map-side: a game with a third of all quotes is no heavier than another.
    Where (game, time) is unique, leave ``tie_break`` empty and the aggregate hashes instead of sorting.
    """
    before = quotes.filter(F.col(ts) <= kickoff).groupBy(game)
    if not tie_break:  # fixed-width buffers: a hash aggregate
        return before.agg(*[F.max_by(c, ts).alias(f"closing_{c}") for c in columns])
    latest = F.max_by(F.struct(*columns), F.struct(F.col(ts), *[F.col(t) for t in tie_break])).alias("__q")
    return before.agg(latest).select(game, *[F.col(f"__q.{c}").alias(f"closing_{c}") for c in columns])


def closing_line_asof(
    bets: DataFrame,
    quotes: DataFrame,
    kickoff: Column,
    game: str = "game_id",
    ts: str = "ts",
    tie_break: Sequence[str] = (),
    columns: Sequence[str] = ("line",),
) -> DataFrame:
    """Bets with the closing values of their game; NULL for a game without a quote before kickoff."""
    return join_back(bets, closing_quotes(quotes, kickoff, game, ts, tie_break, columns), [game])


def asof_quotes(
    bets: DataFrame,
    quotes: DataFrame,
    keys: Sequence[str] = ("game_id",),
    bet_ts: str = "ts",
    quote_ts: str = "ts",
    tie_break: Sequence[str] = (),
    columns: Sequence[str] = ("line",),
    prefix: str = "asof_",
    strict: bool = False,
) -> DataFrame:
    """Every bet with the newest quote of its keys at (or, if ``strict``, before) the bet's own time.

    Bets and quotes are merged in one range exchange over (keys, time), so a game with a third of all rows is many ranges.
    Inside a range the newest quote so far is a running last value; what a range needs from the ranges before is one quote
    for the keys that it begins in, at most one row per range, which is broadcast.  Of quotes at one time the last in
    ``tie_break`` counts.  A bet without a time or a key, or earlier than all quotes, keeps NULL; quotes without either match
    nothing.  Bets are returned as they are, repeated ones as often as they occur.
    """
    keys = list(keys)
    known = reduce(lambda acc, k: acc & F.col(k).isNotNull(), keys, F.lit(True))
    ties = [f"__o{i}" for i in range(len(tie_break))]
    quote = F.struct(*[F.col(c) for c in columns])
    offers = quotes.filter(known & F.col(quote_ts).isNotNull()).select(
        *keys, F.col(quote_ts).alias("__t"), F.lit(0).alias("__kind"), *[F.col(c).alias(o) for c, o in zip(tie_break, ties)], quote.alias("__q")
    )
    # among rows of one time a quote comes first, or last if it has to be earlier
    taken = bets.select(*keys, F.col(bet_ts).alias("__t"), F.lit(-1 if strict else 1).alias("__kind"), F.struct(*[F.col(c) for c in bets.columns]).alias("__bet"))
    taken = taken.withColumn("__mix", F.xxhash64("__bet"))
    both = offers.unionByName(taken, allowMissingColumns=True)
    rows = in_ranges(both, [*keys, "__t", "__kind", *ties, "__mix"], "asof")
    inside = Window.partitionBy(PART, *keys).orderBy(AT).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("__in", F.last("__q", ignorenulls=True).over(inside)).filter(F.col("__bet").isNotNull())
    newest = rows.groupBy(*keys, PART).agg(F.max_by("__q", F.when(F.col("__kind") == 0, F.col(AT))).alias("__q"))
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = newest.select(*keys, PART, F.last("__q", ignorenulls=True).over(before).alias("__carried")).filter(F.col("__carried").isNotNull())
    met = join_back(found, F.broadcast(carried), [*keys, PART])
    newest_quote = F.coalesce("__in", "__carried")
    timed = known & F.col("__t").isNotNull()
    return met.select("__bet.*", *[F.when(timed, newest_quote[c]).alias(f"{prefix}{c}") for c in columns])


def clv_columns(bets: DataFrame, line: str = "line", odds: str = "odds", is_home: str = "is_home") -> DataFrame:
    """Closing-line value in points and in implied probability."""
    return bets.withColumns({
        "clv_points": pricing.clv_points(F.col(line), F.col(f"closing_{line}"), F.col(is_home)),
        "clv_pct": pricing.clv_pct(F.col(odds), F.col(f"closing_{odds}")),
    })


def clv_report(bets: DataFrame, keys: Sequence[str] = ("book",)) -> DataFrame:
    """Bets, mean value against the close and the share that beat it, per book, season or model."""
    points, pct = F.col("clv_points"), F.col("clv_pct")
    return bets.groupBy(*keys).agg(
        F.count(points).alias("bets"),
        F.avg(points).alias("mean_clv_points"),
        F.avg(pct).alias("mean_clv_pct"),
        F.avg((points > 0).cast("int")).alias("share_beating_close"),
    )


def latest_quotes(quotes: DataFrame, game: str = "game_id", ts: str = "ts", tie_break: Sequence[str] = (), columns: Sequence[str] = ("line",)) -> DataFrame:
    """Newest quote per game; works on a batch and, in update mode, on a stream."""
    newest = F.max_by(F.struct(F.col(ts), *columns), F.struct(F.col(ts), *[F.col(t) for t in tie_break])).alias("__q")
    return quotes.groupBy(game).agg(newest).select(game, F.col(f"__q.{ts}").alias(ts), *[F.col(f"__q.{c}").alias(c) for c in columns])
