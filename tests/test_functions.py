"""Literal cases for keys, pricing, scoring and missing values."""

from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hashmark.functions import keys, missing, pricing, scoring


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("odds, expected", [(-110.0, 110 / 210), (150.0, 0.4), (0.0, 1.0)])
def test_implied_probability(spark, odds, expected):
    assert one(spark, pricing.implied_prob(F.lit(odds))) == pytest.approx(expected)


@pytest.mark.parametrize("prob, expected", [(0.5, -100.0), (0.6, -150.0), (0.4, 150.0), (1.0, None), (0.0, None)])
def test_fair_odds(spark, prob, expected):
    got = one(spark, pricing.fair_odds(F.lit(prob)))
    assert got is None if expected is None else got == pytest.approx(expected)


def test_devig(spark):
    assert one(spark, pricing.devig_power(F.lit(-110.0), F.lit(-110.0))) == pytest.approx(0.5)
    assert one(spark, pricing.devig_power(F.lit(-150.0), F.lit(130.0))) == pytest.approx(0.6 / (0.6 + 100 / 230))
    assert one(spark, pricing.devig_power(F.lit(-150.0), F.lit(130.0), 2.0)) == pytest.approx(0.36 / (0.36 + (100 / 230) ** 2))
    assert one(spark, pricing.vig(F.lit(-110.0), F.lit(-110.0))) == pytest.approx(220 / 210 - 1)


def test_ev_kelly_clv(spark):
    assert one(spark, pricing.ev_dollars(F.lit(0.55), F.lit(-110.0))) == pytest.approx(5.0)
    assert one(spark, pricing.ev_pct(F.lit(0.55), F.lit(0.5))) == pytest.approx(0.1)
    assert one(spark, pricing.kelly_full(F.lit(0.55), F.lit(-110.0))) == pytest.approx(0.055)
    assert one(spark, pricing.kelly_fraction(F.lit(0.55), F.lit(-110.0))) == pytest.approx(0.01375)
    assert one(spark, pricing.kelly_full(F.lit(0.3), F.lit(-110.0))) == 0.0
    assert one(spark, pricing.kelly_full(F.lit(None).cast("double"), F.lit(-110.0))) is None
    assert one(spark, pricing.clv_points(F.lit(-3.5), F.lit(-4.5), F.lit(True))) == -1.0
    assert one(spark, pricing.clv_points(F.lit(-3.5), F.lit(-4.5), F.lit(False))) == 1.0
    assert one(spark, pricing.clv_pct(F.lit(-110.0), F.lit(-120.0))) == pytest.approx((120 / 220) / (110 / 210) - 1)


def test_normal_distribution_function(spark):
    zs = [i / 20 for i in range(-800, 801)]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    for z, p in df.select("z", pricing.normal_cdf(F.col("z"))).collect():
        assert p == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), abs=1e-14)
    assert one(spark, pricing.normal_cdf(F.lit(None).cast("double"))) is None
    assert one(spark, pricing.home_win_prob(F.lit(-7.0))) == pytest.approx(0.9998, abs=1e-4)
    assert one(spark, pricing.home_win_prob(F.lit(3.0))) == pytest.approx(0.067, abs=1e-3)


def test_game_keys(spark):
    df = spark.createDataFrame([("2024_01_KC_BUF",), ("2024-01",), (None,)], "game_id string")
    rows = keys.parse_game_key(df).collect()
    assert tuple(rows[0]) == ("2024_01_KC_BUF", 2024, 1, "KC", "BUF")
    assert tuple(rows[1])[1:] == (None,) * 4 and tuple(rows[2])[1:] == (None,) * 4
    back = keys.parse_game_key(df).select(keys.format_game_key().alias("k")).collect()
    assert [r.k for r in back] == ["2024_01_KC_BUF", None, None]


def test_matchups_and_lines(spark):
    df = spark.createDataFrame(
        [("New York Jets at New England Patriots", "NE -10.5", "NE", "NYJ"), ("Washington vs Miami", "WSH PK", "MIA", "WSH"),
         ("Green Bay at New York", "GB -3.5", "NYG", "GB"), ("bye", "Pick em", "A", "B")],
        "matchup string, favorite_line string, h string, a string",
    )
    rows = keys.parse_matchup(df).collect()
    assert (rows[0].away_team, rows[0].home_team, rows[0].is_neutral) == ("New York Jets", "New England Patriots", False)
    assert rows[1].is_neutral is True and rows[3].home_team is None
    lines = keys.parse_quoted_line(df, home_code="h", away_code="a").collect()
    assert [r.quoted_line for r in lines] == [-10.5, None, -3.5, None]
    assert [r.home_line for r in lines] == [-10.5, None, 3.5, None]
    zero = keys.parse_quoted_line(df, home_code="h", away_code="a", pick_as_zero=True).collect()
    assert [r.quoted_line for r in zero] == [-10.5, 0.0, -3.5, 0.0]
    assert one(spark, keys.first_listed(F.lit("cle, cin"))) == "cle"


def test_weighted_score(spark):
    df = spark.createDataFrame([(0.15, 0.0, 100.0, 0.0, 5.0, 0.0), (None, 0.0, 100.0, 0.0, 5.0, 0.0)],
                               "epa_margin_home double, epa_margin_away double, rating_home double, rating_away double, overall_home double, overall_away double")
    score = scoring.weighted_rating_score(scoring.rating_terms(scoring.BASE_WEIGHTS))
    assert [r.s for r in df.select(score.alias("s")).collect()] == pytest.approx([-12.25, -7.0])


@pytest.mark.parametrize("home, away, points", [(14, 7, 0.05), (7, 14, -0.05), (6, 7, -0.125), (7, 6, 0.125), (15, 6, 0.175), (None, 6, 0.0), (14, 14, 0.0)])
def test_rest_situation(spark, home, away, points):
    df = spark.createDataFrame([(home, away)], "home_rest int, away_rest int")
    assert scoring.rest_situation(df).first()["rest_adj"] == pytest.approx(points)


def test_flags_of_ties_and_unplayed_games(spark):
    df = spark.createDataFrame([(20, 20, -3.0), (None, None, 1.0), (24, 20, None)], "home_score int, away_score int, home_line double")
    rows = scoring.result_flags(df).collect()
    assert (rows[0].home_win, rows[0].away_win, rows[0].home_ats_cover, rows[0].away_ats_cover) == (0, 0, 0, 1)
    assert rows[1].home_win is None and rows[1].point_diff is None
    assert rows[2].home_win == 1 and rows[2].home_ats_cover is None


def test_missing_columns_raise(spark):
    with pytest.raises(ValueError):
        scoring.rest_from_modifiers(spark.range(1))


def test_missing_values(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, nan), (nan, 2.0), (3.0, 4.0)], "a double, b double")
    clean = missing.nan_to_null(df)
    assert [tuple(r) for r in clean.collect()] == [(1.0, None), (None, 2.0), (3.0, 4.0)]
    assert missing.require_complete(clean, ["a", "b"]).count() == 1
    assert missing.fill_defaults(clean, {"a": 7}).first()["a"] == 1.0
    assert missing.fill_defaults(clean, {"b": 7}).first()["b"] == 7.0
    assert one(spark, F.bround(F.lit(-3.25), 1)) == -3.2


@settings(max_examples=25, deadline=None)
@given(odds=st.lists(st.one_of(st.integers(-2000, -100), st.integers(100, 2000)), min_size=1, max_size=40))
def test_pricing_identities(spark, odds):
    df = spark.createDataFrame([(float(o),) for o in odds], "o double")
    o = F.col("o")
    p = pricing.implied_prob(o)
    rows = df.select(
        p.alias("p"), pricing.implied_prob(pricing.fair_odds(p)).alias("back"), pricing.ev_dollars(p, o).alias("ev"),
        (pricing.devig_power(o, F.lit(-110.0)) + pricing.devig_power(F.lit(-110.0), o)).alias("whole"),
    ).collect()
    for r in rows:
        assert 0 < r.p < 1 and r.back == pytest.approx(r.p) and r.ev == pytest.approx(0, abs=1e-9) and r.whole == pytest.approx(1)
