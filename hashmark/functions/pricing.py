"""Market pricing as Catalyst expressions: no UDF, everything stays in whole-stage codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

STANDARD_ODDS = -110.0
STANDARD_STAKE = 100.0
KELLY_SHARE = 0.25

# Hart's rational approximation of the normal distribution function (double precision),
# coefficients from the highest power down, and the switch to a continued fraction in the tail.
HART_TOP = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
HART_BOTTOM = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
HART_TAIL_FROM = 7.07106781186547
HART_ZERO_FROM = 37.0
ROOT_TWO_PI = 2.506628274631


def implied_prob(odds: Column) -> Column:
    """Implied probability of American odds (also the break-even win rate)."""
    return F.when(odds < 0, -odds / (F.lit(100.0) - odds)).otherwise(F.lit(100.0) / (odds + 100.0))


def fair_odds(prob: Column) -> Column:
    """American odds of a probability; NULL at 0 and 1, which have no odds."""
    favourite = F.try_divide(prob * -100.0, F.lit(1.0) - prob)
    underdog = F.try_divide((F.lit(1.0) - prob) * 100.0, prob)
    return F.when(prob >= 0.5, favourite).otherwise(underdog)


def devig_power(own: Column, other: Column, k: float = 1.0) -> Column:
    """Share of ``own`` after raising both implied probabilities to ``k``; 1 is the multiplicative rule."""
    a, b = implied_prob(own), implied_prob(other)
    if k != 1.0:
        a, b = F.pow(a, F.lit(float(k))), F.pow(b, F.lit(float(k)))
    return F.try_divide(a, a + b)


def vig(home: Column, away: Column) -> Column:
    """Overround of a two-way market."""
    return implied_prob(home) + implied_prob(away) - 1.0


def net_payout(odds: Column) -> Column:
    """Profit per unit staked on a winning bet; NULL for odds of zero on the favourite side."""
    return F.when(odds < 0, F.lit(-100.0) / odds).otherwise(odds / 100.0)


def ev_dollars(prob: Column, odds: Column, stake: float = STANDARD_STAKE) -> Column:
    """Expected profit of a stake.  p = .55 at -110 gives 5.0 on 100."""
    return ev_at(prob, F.lit(1.0) - prob, net_payout(odds), stake)


def ev_at(win: Column, lose: Column, payout: Column, stake: float = STANDARD_STAKE) -> Column:
    """Expected profit of a stake from both probabilities and the profit per unit staked."""
    return win * payout * float(stake) - lose * float(stake)


def ev_pct(prob: Column, market_prob: Column) -> Column:
    """Edge over the vig-free market probability."""
    return F.try_divide(prob - market_prob, market_prob)


def kelly_full(prob: Column, odds: Column) -> Column:
    """Kelly share of the bankroll, never negative; NULL probability stays NULL."""
    return kelly_at(prob, F.lit(1.0) - prob, net_payout(odds))


def kelly_at(win: Column, lose: Column, payout: Column) -> Column:
    """Kelly share from both probabilities and the profit per unit staked."""
    raw = F.try_divide(payout * win - lose, payout)
    return F.when(raw.isNotNull(), F.greatest(F.lit(0.0), raw))


def kelly_fraction(prob: Column, odds: Column, share: float = KELLY_SHARE) -> Column:
    """A fixed share of full Kelly."""
    return kelly_full(prob, odds) * float(share)


def clv_points(bet_line: Column, closing_line: Column, is_home: Column) -> Column:
    """Closing minus bet line for a home bet, the reverse for an away bet (-3.5 closing at -4.5: -1)."""
    return F.when(is_home, closing_line - bet_line).otherwise(bet_line - closing_line)


def clv_pct(bet_odds: Column, closing_odds: Column) -> Column:
    """Relative change of the implied probability from bet to close."""
    taken = implied_prob(bet_odds)
    return F.try_divide(implied_prob(closing_odds) - taken, taken)


def normal_cdf(z: Column, size: Column | None = None) -> Column:
    """Standard normal distribution function, accurate to double precision.

    ``size`` may name a column that holds ``abs(z)`` (0 where ``z`` is NULL), so that it is not worked out for every term.
    """
    size = F.abs(z) if size is None else size
    density = F.exp(size * size / -2.0)

    def horner(coefficients: tuple[float, ...]) -> Column:
        return reduce(lambda acc, c: acc * size + F.lit(c), coefficients[1:], F.lit(coefficients[0]))

    centre = horner(HART_TOP) / horner(HART_BOTTOM)
    fraction = reduce(lambda acc, n: size + F.lit(float(n)) / acc, (4, 3, 2, 1), size + 0.65)
    tail = F.lit(1.0) / (fraction * ROOT_TWO_PI)
    upper = F.when(size > HART_ZERO_FROM, F.lit(0.0)).otherwise(density * F.when(size < HART_TAIL_FROM, centre).otherwise(tail))
    return F.when(z > 0, F.lit(1.0) - upper).otherwise(F.when(z.isNotNull(), upper))


def home_win_prob(spread: Column, sigma: float | Column = 2.0) -> Column:
    """Probability that the home side wins when the home-perspective spread has error sigma."""
    scale = sigma if isinstance(sigma, Column) else F.lit(float(sigma))
    return normal_cdf(F.try_divide(F.negative(spread), scale))
