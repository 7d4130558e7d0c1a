"""Dirty inputs, guards, plans and invariants of the relational operators."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hashmark.catalog.bindings import games, plays, team_week
from hashmark.functions.scoring import edge_columns
from hashmark.operators import joins, models, periods, quality, reports, reshape, windows
from hashmark.plans import evaluation
from hashmark.sources import contracts
from hashmark.sources.franchises import franchise_aliases

PLAY = "season int, week int, posteam string, defteam string, play_type string, epa double, success double, down int, third_down_converted double, yardline_100 double, touchdown double, yards_gained double, interception double, fumble_lost double"


def play(posteam="KC", defteam="BUF", kind="pass", epa=0.1, success=1.0, down=1, week=1, **more):
    base = dict(third=None, yard=50.0, td=0.0, gain=5.0, pick=0.0, fumble=0.0) | more
    return (2024, week, posteam, defteam, kind, epa, success, down, base["third"], base["yard"], base["td"], base["gain"], base["pick"], base["fumble"])


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_missing_epa_counts_in_rates_not_in_means(spark):
    df = spark.createDataFrame([play(epa=1.0), play(epa=None), play(kind="run", epa=-1.0), play(kind="punt", epa=9.0)], PLAY)
    row = periods.offense_by_period(df).first()
    assert row.off_plays == 3 and row.off_epa_total == 0.0 and row.off_epa_per_play == 0.0
    assert row.off_explosive_rate == pytest.approx(1 / 3)
    assert row.off_third_down_plays == 0 and row.off_third_down_conv_rate is None and row.off_redzone_td_rate is None


def test_all_missing_epa(spark):
    row = periods.offense_by_period(spark.createDataFrame([play(epa=None)], PLAY)).first()
    assert row.off_epa_total == 0.0 and row.off_epa_per_play is None


def test_team_needs_both_sides(spark):
    df = spark.createDataFrame([play(), play("BUF", "KC"), play("NE", "KC"), play(None, "NYJ")], PLAY)
    got = periods.team_period_stats(df)
    assert sorted(r.team for r in got.collect()) == ["BUF", "KC"]
    kc = got.filter("team = 'KC'").first()
    assert (kc.off_plays, kc.def_plays) == (1, 2)


def test_third_down_red_zone_big_plays_turnovers(spark):
    df = spark.createDataFrame(
        [play(down=3, third=1.0), play(down=3, third=0.0), play(yard=20.0, td=1.0), play(gain=20.0, pick=1.0, fumble=1.0)], PLAY
    )
    r = periods.offense_by_period(df).first()
    assert (r.off_third_down_plays, r.off_third_down_conv_rate) == (2, 0.5)
    assert (r.off_redzone_plays, r.off_redzone_td_rate) == (1, 1.0)
    assert (r.off_plays_20plus_yards, r.off_plays_20plus_rate) == (1, 0.25)
    assert (r.off_interceptions, r.off_fumbles_lost, r.off_turnover_rate) == (1, 1, 0.25)


def test_plays_are_combined_before_the_shuffle(spark, sf_dir):
    text = plan(periods.team_period_stats(plays(spark, sf_dir)))
    first_exchange = text.index("Exchange hashpartitioning")
    assert "partial_" in text[first_exchange:] and "SortMergeJoin" not in text and "SortAggregate" not in text
    assert "l_comment" not in text


def test_form_is_one_window(spark, sf_dir):
    text = plan(windows.team_form(team_week(spark, sf_dir)))
    assert text.count("Window [") == 1


def test_filters_and_columns_reach_the_reader(spark, sf_dir):
    from hashmark.functions.missing import require_complete

    df = require_complete(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_tax"]).filter("l_quantity > 10").select("l_orderkey")
    text = plan(df)
    assert "IsNotNull(l_tax)" in text and "GreaterThan(l_quantity,10.0)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_tax:double>" in text


def test_small_dimension_is_broadcast(spark, sf_dir):
    dim = spark.createDataFrame([("T1", 1.0), ("T2", 2.0)], "team string, rating double")
    joined = joins.join_both_sides(games(spark, sf_dir), dim)
    joined.collect()  # adaptive execution has seen the dimension's bytes then
    final = joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in final


def test_last_n_is_limited_before_the_shuffle(spark, sf_dir):
    text = plan(windows.last_n_summary(reshape.to_team_games(games(spark, sf_dir))))
    assert "WindowGroupLimit" in text and text.rindex("WindowGroupLimit") > text.index("Exchange")


def test_duplicate_ratings_stop_the_join(spark, sf_dir):
    dim = spark.createDataFrame([("T1", 1.0), ("T1", 2.0)], "team string, rating double")
    with pytest.raises(Exception, match="not unique"):
        joins.join_both_sides(games(spark, sf_dir), dim).collect()


def test_merge_and_audit(spark):
    base = spark.createDataFrame([("BUF", 1.0), ("KC", 2.0)], "team string, rating double")
    other = spark.createDataFrame([("BUF", 3.0), ("KC", 4.0), ("PHI", 5.0)], "team string, rating double")
    merged, skipped = joins.merge_ratings(base, [("b", other), ("c", None), ("d", other.drop("team"))])
    assert merged.columns == ["team", "rating", "rating_b"] and merged.count() == 2
    assert skipped == [("c", "missing"), ("d", "no key")]
    assert [r.team for r in joins.merge_audit(base, other).collect()] == ["PHI"]
    with pytest.raises(ValueError):
        joins.merge_ratings(None, [])


def test_team_spellings(spark):
    spelled = ["Rams", "ram", "Los Angeles Rams", "kan", " Bills ", "OAK", "sd", "New York", "49ERS", None]
    df = spark.createDataFrame([(s,) for s in spelled], "name string")
    aliases = franchise_aliases(spark)
    assert aliases.select("code").distinct().count() == 32
    got = {r.name: r.team for r in joins.normalize_entity(df, "name", aliases, on_unknown="keep").collect()}
    assert got == dict(zip(spelled, ["LAR", "LAR", "LAR", "KC", "BUF", "LV", "LAC", None, "SF", None]))
    assert joins.normalize_entity(df, "name", aliases, on_unknown="drop").count() == 8
    with pytest.raises(Exception, match="unknown name"):
        joins.normalize_entity(df, "name", aliases, on_unknown="fail").collect()


def test_upsert_is_idempotent_and_last_wins(spark):
    old = spark.createDataFrame([(2024, 1, "KC", 1.0), (2024, 2, "KC", 2.0)], "season int, week int, team string, x double")
    new = spark.createDataFrame([(2024, 2, "KC", 9.0), (2024, 3, "KC", 3.0)], old.schema)
    keys = ["season", "week", "team"]
    once = reshape.upsert_period(old, new, keys)
    twice = reshape.upsert_period(once, new, keys)
    assert sorted(once.collect()) == sorted(twice.collect())
    assert sorted(r.x for r in once.collect()) == [1.0, 3.0, 9.0]


def test_scores_and_registry(spark):
    df = spark.createDataFrame([(10.0, 1.0)], "a double, b double")
    registry = joins.registry_frame(spark, {"m": {"intercept": 1.0, "a": 2.0}, "n": {"b": 3.0}})
    scored = joins.score_models(df, joins.read_registry(registry))
    assert {r.model: r.pred for r in scored.collect()} == {"m": 21.0, "n": 3.0}
    with pytest.raises(KeyError):
        joins.score_models(df, {"m": {}}, ["x"])
    with pytest.raises(ValueError):
        joins.read_registry(registry, max_rows=2)


def test_slate_keeps_one_schema_and_rejects_unknown_models(spark):
    matchups = spark.createDataFrame([(2024, 1, "KC", "BUF", -2.5)], "season int, week int, away_team string, home_team string, home_line double")
    ratings = spark.createDataFrame([("KC", 1600.0), ("BUF", 1650.0)], "team string, rating double")
    none = spark.createDataFrame([], "team string, adjustment double, reason string")
    some = spark.createDataFrame([("BUF", 1.5, "healthy")], none.schema)
    a, b = (evaluation.weekly_slate(matchups, ratings, x).first() for x in (none, some))
    assert a.asDict().keys() == b.asDict().keys()
    assert (a.game_id, a.model_line, a.final_line, a.edge) == ("2024_01_KC_BUF", -3.5, -3.5, -1.0)
    assert (b.final_line, b.edge, b.subjective_reason_home) == (-2.0, 0.5, "healthy")
    with pytest.raises(KeyError):
        evaluation.weekly_slate(matchups, ratings, none, model="v1.3")


def test_bins_are_right_closed_and_empty_bins_listed(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (1.0,), (5.0,)], "edge double")
    got = reports.edge_histogram(df, [-2, 0, 1, 2], ["a", "b", "c"]).collect()
    assert [(r.label, r.n) for r in got] == [("a", 2), ("b", 1), ("c", 0)]


def test_roi_bins(spark):
    df = spark.createDataFrame([(10.0, -4.0, -3.0), (-10.0, -4.0, -3.0), (3.0, 0.0, -6.0)], "actual_margin double, pred double, home_line double")
    got = {(r.level, r.edge_bin): (r.n_bets, r.win_rate) for r in reports.roi_by_edge_bin(df).collect()}
    assert got == {("bin", 1.0): (2, 0.5), ("bin", 5.0): (1, 1.0), ("all", None): (3, pytest.approx(2 / 3))}


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3)) * [1, 100, 0.01] + [5, 1e6, 0]
    y = x @ [0.5, -0.02, 30] + rng.normal(size=400)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)] + [(None, 1.0, 1.0, 1.0)], "a double, b double, c double, y double")
    for alpha in (0.0, 1.0, 100.0):
        got = {r.term: r.weight for r in models.fit_ridge(df, ["a", "b", "c"], "y", alpha).collect()}
        centred = x - x.mean(0)
        want = np.linalg.solve(centred.T @ centred + alpha * np.eye(3), centred.T @ (y - y.mean()))
        assert [got[c] for c in "abc"] == pytest.approx(list(want), rel=1e-6)
        assert got["intercept"] == pytest.approx(y.mean() - want @ x.mean(0), rel=1e-6)


def test_time_split_cv(spark):
    rng = np.random.default_rng(9)
    n, k = 130, 5
    x, y = rng.normal(size=n), rng.normal(size=n)
    rows = [(i // 20, i % 20 // 4, i, float(x[i]), float(2 * x[i] + y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "season int, week int, game_id int, x double, y double").repartition(6)
    got = {r.alpha: r.cv_mae for r in models.cv_ridge_time(df, ["x"], "y", (0.1, 50.0), k, ["season", "week"]).collect()}
    size = n // (k + 1)
    order = np.array([r[3:] for r in sorted(rows)])
    for alpha, found in got.items():
        errors = []
        for start in range(n - k * size, n, size):
            a, b = order[:start], order[start:start + size]
            ax, ay = a[:, 0] - a[:, 0].mean(), a[:, 1] - a[:, 1].mean()
            w = (ax @ ay) / (ax @ ax + alpha)
            errors.append(np.abs(b[:, 1] - (a[:, 1].mean() + w * (b[:, 0] - a[:, 0].mean()))).mean())
        assert found == pytest.approx(np.mean(errors))
    assert models.best_alpha(models.cv_ridge_time(df, ["x"], "y", (0.1, 50.0), k, ["season", "week"])) == min(got, key=got.get)


@pytest.mark.parametrize("contract", contracts.ALL, ids=lambda c: c.name)
def test_contracts(spark, contract):
    typed = {c: "double" if c in contract.numeric else "string" for c in (*contract.required, *contract.optional)}
    schema = ", ".join(f"{c} {t}" for c, t in typed.items())
    good = spark.createDataFrame([tuple(1.0 if t == "double" else "x" for t in typed.values())], schema)
    assert quality.check_contract(good, contract).filter("NOT ok").count() == 0
    assert quality.enforce_contract(good, contract) is good
    with pytest.raises(ValueError, match="no rows"):
        quality.enforce_contract(good.limit(0), contract)
    if contract.required:
        with pytest.raises(ValueError, match="missing column"):
            quality.enforce_contract(good.drop(contract.required[0]), contract)
    if contract.numeric:
        column = contract.numeric[0]
        with pytest.raises(ValueError, match="not numeric"):
            quality.enforce_contract(good.withColumn(column, F.lit("x")), contract)


def test_quality_of_a_clean_frame(spark):
    df = spark.createDataFrame([("g1", "A", "B", 1.0)], "game_id string, home_team string, away_team string, final_line double")
    assert quality.run_quality_suite(df).agg(F.sum("n")).first()[0] == 0


def test_edge_of_a_missing_line(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, 3.0)], "pred double, home_line double")
    rows = edge_columns(df).collect()
    assert (rows[0].edge, rows[0].bet_side, rows[1].bet_side) == (None, None, "home")


def test_next_period_falls_back_to_the_last(spark, sf_dir):
    g = games(spark, sf_dir)
    last = g.agg(F.max(F.struct("season", "week"))).first()[0]
    assert tuple(reports.next_period(g, "2090-01-01").first()) == tuple(last)


def test_rows_without_a_key_do_not_stop_a_join(spark, sf_dir):
    dim = spark.createDataFrame([("T1", 5.0), (None, 1.0), (None, 2.0)], "team string, rating double")
    joined = joins.join_both_sides(games(spark, sf_dir).drop("rating_home", "rating_away"), dim)
    assert joined.count() == games(spark, sf_dir).count() and joined.filter("rating_home = 5").count() > 0


def test_each_predictor_is_bucketed_by_its_own_line(spark):
    df = spark.createDataFrame([(20.0, -2.0, 7.0), (20.0, -20.0, 7.0)], "market double, model double, actual_margin double")
    card = {r.predictor: r for r in reports.predictor_scorecard(df, ["model"], "market").collect()}
    assert card["model"].mae_spread_0_3 == 5.0 and card["model"].mae_spread_14_100 == 13.0
    assert card["market"].mae_spread_0_3 is None and card["market"].mae_spread_14_100 == 27.0


def test_outer_histogram_bins_are_open(spark):
    df = spark.createDataFrame([(150.0,), (-150.0,), (1.0,)], "edge double")
    rows = reports.edge_histogram(df, [float("-inf"), -10, 10, float("inf")], ["low", "mid", "high"]).collect()
    assert [r.n for r in rows] == [1, 1, 1]


def test_games_are_folded_back_whole(spark):
    """Repeated games, games of one key and games without one come back as often as they were there, with their own columns."""
    import datetime as dt

    from hashmark.operators.windows import rest_days

    day = dt.date(2024, 9, 1)
    rows = [(1, 2024, 1, day, "A", "B", "x"), (1, 2024, 1, day, "A", "B", "x"), (1, 2024, 1, day, "C", "D", "y"), (2, 2024, 2, day + dt.timedelta(7), "A", "C", None), (None, 2024, 3, None, "B", None, "z")]
    games = spark.createDataFrame(rows, "game_id int, season int, week int, gameday date, home_team string, away_team string, note string").repartition(3)
    got = rest_days(games)
    assert got.columns == [*games.columns, "home_rest_days", "away_rest_days", "rest_advantage"]
    assert sorted(map(str, got.select(games.columns).collect())) == sorted(map(str, games.collect()))
    assert [(r.home_rest_days, r.away_rest_days, r.rest_advantage) for r in got.filter("game_id = 2").collect()] == [(7, 7, 0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_quality_suite_scans_each_frame_once(spark, sf_dir):
    from hashmark.catalog.quality import dirty, rested
    from hashmark.operators.quality import run_quality_suite

    frame = dirty(spark, sf_dir)
    plan = run_quality_suite(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == frame._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    whole = run_quality_suite(frame, rested(spark, sf_dir).select("home_team", "away_team", "rest_advantage"))
    assert {r["check"] for r in whole.collect()} >= {"duplicate_key", "duplicate_pair", "rest_anomaly", "null_feature"}
    empty = run_quality_suite(frame.limit(0)).collect()
    assert {r.n for r in empty} == {0}


def test_family_report_counts_values(spark):
    from hashmark.operators.families import family_report

    df = spark.createDataFrame([(1, None, 2.0), (3, None, None)], "rest_a int, qb_b string, other double")
    rows = {tuple(r) for r in family_report(df, {"rest": ["rest_"], "all": ["_"], "none": ["zzz"]}).collect()}
    assert rows == {("rest", "rest_a", "int", 2), ("all", "rest_a", "int", 2), ("all", "qb_b", "string", 0)}
    assert family_report(df, {"none": ["zzz"]}).collect() == []


def test_slate_weights_fall_back_term_by_term(spark):
    from hashmark.functions.scoring import BASE_WEIGHTS, STRUCTURAL_WEIGHTS
    from hashmark.plans.evaluation import slate_weights

    rows = [("v1.1", "rating", 0.5), ("v1.1", "overall", None), ("v1.1", "qb_adj", float("nan")), ("own", "rating", 1.0), ("v1.0", "extra", 2.0)]
    registry = spark.createDataFrame(rows, "model string, term string, weight double")
    assert slate_weights("v1.0") == BASE_WEIGHTS and slate_weights("v1.1") == {**BASE_WEIGHTS, **STRUCTURAL_WEIGHTS}
    assert slate_weights("v1.1", registry) == {**BASE_WEIGHTS, **STRUCTURAL_WEIGHTS, "rating": 0.5}
    assert slate_weights("v1.0", registry) == {**BASE_WEIGHTS, "extra": 2.0} and slate_weights("own", registry) == {"rating": 1.0}
    for unknown in (None, registry):
        with pytest.raises(KeyError, match="unknown model"):
            slate_weights("v7", unknown)
