"""Pricing, closing lines and closing-line value over the quote binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from hashmark.catalog.bindings import KICKOFF, phi_sql, quotes, sql
from hashmark.catalog.registry import query
from hashmark.operators import market

_PRICE_FLOATS = (
    "implied_prob_home implied_prob_away devig_mult_home devig_mult_away devig_power_home devig_power_away vig break_even "
    "home_win_prob fair_odds_home ev_dollars ev_pct kelly_full kelly_quarter fair_odds_away ev_dollars_away ev_pct_away kelly_full_away kelly_quarter_away"
)


def _implied(o: str) -> str:
    return f"(CASE WHEN {o} < 0 THEN -{o} / (-{o} + 100) ELSE 100 / ({o} + 100) END)"


@query(
    "price_quotes",
    sql(
        f"""SELECT event_id, ih AS implied_prob_home, ia AS implied_prob_away, ih / (ih + ia) AS devig_mult_home, ia / (ih + ia) AS devig_mult_away,
        pow(ih, 2) / (pow(ih, 2) + pow(ia, 2)) AS devig_power_home, pow(ia, 2) / (pow(ih, 2) + pow(ia, 2)) AS devig_power_away, ih + ia - 1 AS vig, ih AS break_even,
        p AS home_win_prob, CASE WHEN m >= 0.5 THEN -100 * m / (1 - m) ELSE 100 * (1 - m) / m END AS fair_odds_home,
        p * b * 100 - (1 - p) * 100 AS ev_dollars, (p - m) / m AS ev_pct, greatest(0, (b * p - (1 - p)) / b) AS kelly_full, 0.25 * greatest(0, (b * p - (1 - p)) / b) AS kelly_quarter,
        CASE WHEN 1 - m >= 0.5 THEN -100 * (1 - m) / m ELSE 100 * m / (1 - m) END AS fair_odds_away, (1 - p) * c * 100 - p * 100 AS ev_dollars_away,
        ((1 - p) - (1 - m)) / (1 - m) AS ev_pct_away, greatest(0, (c * (1 - p) - p) / c) AS kelly_full_away, 0.25 * greatest(0, (c * (1 - p) - p) / c) AS kelly_quarter_away
        FROM (SELECT *, ih / (ih + ia) AS m, CASE WHEN home_odds < 0 THEN 100 / -home_odds ELSE home_odds / 100 END AS b,
          CASE WHEN away_odds < 0 THEN 100 / -away_odds ELSE away_odds / 100 END AS c FROM (
          SELECT *, {_implied('home_odds')} AS ih, {_implied('away_odds')} AS ia, {phi_sql('(-line / 13.0::double)')} AS p FROM Q))""",
        "Q",
    ),
    _PRICE_FLOATS,
)
def _(spark, sf_dir):
    priced = market.price_quotes(quotes(spark, sf_dir), sigma=13.0)
    return priced.select("event_id", *_PRICE_FLOATS.split())


_CLOSE = f"""(SELECT game_id, max_by(line, (ts, event_id)) AS closing_line, max_by(home_odds, (ts, event_id)) AS closing_home_odds
  FROM Q WHERE ts <= TIMESTAMP '{KICKOFF}' GROUP BY game_id)"""


def closed(spark, sf_dir):
    q = quotes(spark, sf_dir)
    kickoff = F.lit(KICKOFF).cast("timestamp_ntz")
    return market.closing_line_asof(q, q, kickoff, tie_break=["event_id"], columns=["line", "home_odds"])


@query("closing_line_asof", sql(f"SELECT event_id, Q.game_id, line, closing_line FROM Q LEFT JOIN {_CLOSE} c ON c.game_id = Q.game_id", "Q"))
def _(spark, sf_dir):
    return closed(spark, sf_dir).select("event_id", "game_id", "line", "closing_line")


@query(
    "asof_quotes",
    sql(
        """SELECT b.event_id, b.game_id, b.ts, b.line, max_by(q.line, (q.ts, q.event_id)) FILTER (q.ts <= b.ts) AS asof_line,
        max_by(q.home_odds, (q.ts, q.event_id)) FILTER (q.ts <= b.ts) AS asof_home_odds, max_by(q.line, (q.ts, q.event_id)) FILTER (q.ts < b.ts) AS earlier_line
        FROM Q b JOIN Q q ON q.game_id = b.game_id GROUP BY b.event_id, b.game_id, b.ts, b.line""",
        "Q",
    ),
)
def _(spark, sf_dir):
    """Every event is a bet at its own time and a quote: the newest quote up to then, and the newest one before."""
    q = quotes(spark, sf_dir)
    at = market.asof_quotes(q, q, tie_break=["event_id"], columns=["line", "home_odds"])
    both = market.asof_quotes(at, q, tie_break=["event_id"], prefix="earlier_", strict=True)
    return both.select("event_id", "game_id", "ts", "line", "asof_line", "asof_home_odds", "earlier_line")


_CLV = f"""(SELECT event_id, book, CASE WHEN is_home THEN closing_line - line ELSE line - closing_line END AS clv_points,
  ({_implied('closing_home_odds')} - {_implied('home_odds')}) / {_implied('home_odds')} AS clv_pct FROM Q LEFT JOIN {_CLOSE} c ON c.game_id = Q.game_id)"""


@query("clv_columns", sql(f"SELECT * FROM {_CLV}", "Q"), "clv_points clv_pct")
def _(spark, sf_dir):
    return market.clv_columns(closed(spark, sf_dir), odds="home_odds").select("event_id", "book", "clv_points", "clv_pct")


@query(
    "clv_report",
    sql(
        f"""SELECT book, count(clv_points) AS bets, avg(clv_points) AS mean_clv_points, avg(clv_pct) AS mean_clv_pct,
        avg(CASE WHEN clv_points > 0 THEN 1 WHEN clv_points IS NOT NULL THEN 0 END) AS share_beating_close FROM {_CLV} GROUP BY book""",
        "Q",
    ),
    "mean_clv_points mean_clv_pct share_beating_close",
)
def _(spark, sf_dir):
    return market.clv_report(market.clv_columns(closed(spark, sf_dir), odds="home_odds"))


@query("latest_quotes", sql("SELECT game_id, max(ts) AS ts, max_by(line, (ts, event_id)) AS line FROM Q GROUP BY game_id", "Q"))
def _(spark, sf_dir):
    return market.latest_quotes(quotes(spark, sf_dir), tie_break=["event_id"])
