"""Literal single-operator cases for rolling form."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hashmark.operators.windows import audit_leakage, defense_form, offense_form, team_form

SCHEMA = "team string, season int, week int, off_epa_per_play double, off_success_rate double, def_epa_per_play double, def_success_rate double"


def weeks(spark, *rows):
    full = [(t, s, w, e, (e or 0) + 0.3, None if e is None else -e, 0.4) for t, s, w, e in rows]
    return spark.createDataFrame(full, SCHEMA)


def values(df, column, team="KC"):
    rows = df.filter(F.col("team") == team).orderBy("season", "week").collect()
    return [None if r[column] is None else round(r[column], 9) for r in rows]


def test_only_past_weeks(spark):
    df = weeks(spark, *[("KC", 2024, w, w / 10) for w in (1, 2, 3, 4)])
    form = team_form(df)
    assert values(form, "offense_form_epa") == [None, 0.1, 0.15, 0.2]
    assert values(form, "offense_form_success") == [None, 0.4, 0.45, 0.5]
    assert values(form, "defense_form_epa")[:3] == [None, -0.1, -0.15]


@pytest.mark.parametrize("window, week, expected", [(2, 4, 0.25), (4, 5, 0.25)])
def test_window_size(spark, window, week, expected):
    df = weeks(spark, *[("KC", 2024, w, w / 10) for w in range(1, 7)])
    assert values(offense_form(df, window), "offense_form_epa")[week - 1] == pytest.approx(expected)


def test_teams_do_not_mix(spark):
    df = weeks(spark, ("KC", 2024, 1, 0.1), ("KC", 2024, 2, 0.2), ("BUF", 2024, 1, 0.3), ("BUF", 2024, 2, 0.4))
    form = offense_form(df)
    assert values(form, "offense_form_epa", "KC") == [None, 0.1]
    assert values(form, "offense_form_epa", "BUF") == [None, 0.3]


def test_input_order_does_not_matter(spark):
    df = weeks(spark, ("KC", 2024, 3, 0.3), ("KC", 2024, 1, 0.1), ("KC", 2024, 2, 0.2))
    assert values(offense_form(df), "offense_form_epa") == [None, 0.1, 0.15]
    assert values(offense_form(df.repartition(7)), "offense_form_epa") == [None, 0.1, 0.15]


def test_seasons_are_crossed(spark):
    df = weeks(spark, ("KC", 2023, 17, 0.1), ("KC", 2023, 18, 0.2), ("KC", 2024, 1, 0.3), ("KC", 2024, 2, 0.4))
    assert values(offense_form(df), "offense_form_epa")[3] == pytest.approx(0.2)


def test_null_is_skipped(spark):
    df = weeks(spark, ("KC", 2024, 1, 0.1), ("KC", 2024, 2, None), ("KC", 2024, 3, 0.3), ("KC", 2024, 4, 0.4))
    assert values(offense_form(df), "offense_form_epa")[2] == pytest.approx(0.1)


def test_missing_columns_give_null_form(spark):
    df = weeks(spark, ("KC", 2024, 1, 0.1), ("KC", 2024, 2, 0.2)).drop("off_success_rate", "def_epa_per_play", "def_success_rate")
    form = team_form(df)
    assert form.columns == ["team", "season", "week", "offense_form_epa", "offense_form_success", "defense_form_epa", "defense_form_success"]
    assert values(form, "offense_form_success") == [None, None]
    assert values(form, "offense_form_epa") == [None, 0.1]


def test_defense_names(spark):
    form = defense_form(weeks(spark, ("KC", 2024, 1, 0.1)))
    assert form.columns == ["team", "season", "week", "defense_form_epa", "defense_form_success"]


def test_audit_finds_no_leak_in_form_and_catches_one(spark):
    df = weeks(spark, *[(t, 2024, w, w * (1 if t == "KC" else 2) / 10) for t in ("KC", "BUF") for w in range(1, 9)])
    form = offense_form(df, 3, keep=["off_epa_per_play"]).withColumn("current", F.col("off_epa_per_play"))
    clean = audit_leakage(form, "offense_form_epa", "off_epa_per_play", 3).first()
    leaky = audit_leakage(form, "current", "off_epa_per_play", 3).first()
    assert (clean["rows_checked"], clean["rows_leaking"]) == (16, 0)
    assert leaky["rows_leaking"] == 16
