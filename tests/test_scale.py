"""The helpers that keep hot keys and global orders out of one task, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hashmark.operators import scale
from hashmark.operators.joins import attach_season_means, matchup_features
from hashmark.operators.windows import recent_form, rest_days, rolling_multi
from hashmark.plans.datasets import team_feature_frame


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows belong to one key; several rows share a period."""
    rng = random.Random(7)
    rows = []
    for i in range(600):
        key = "hot" if i % 2 else f"k{rng.randrange(6)}"
        rows.append((key, rng.randrange(4), rng.randrange(6), i, None if i % 13 == 0 else float(rng.randrange(100))))
    return spark.createDataFrame(rows, "team string, season int, week int, game_id int, x double")


@pytest.mark.parametrize("chunk_rows", [3, 10, 50, 1000])
def test_chunked_frames_equal_plain_windows(spark, skewed, chunk_rows):
    got = rolling_multi(skewed, {"x": "x"}, (1, 3, 10), order=["season", "week", "game_id"], coarse=["season", "week"], chunk_rows=chunk_rows)
    base = Window.partitionBy("team").orderBy("season", "week", "game_id")
    want = skewed.withColumns({f"x_L{n}": F.avg("x").over(base.rowsBetween(-n, -1)) for n in (1, 3, 10)})
    columns = ["game_id", "x_L1", "x_L3", "x_L10"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_no_chunk_holds_the_hot_key(spark, skewed):
    split = scale.split_histories(skewed, ["team"], ["season", "week", "game_id"], 2, ["season", "week"], chunk_rows=20)
    largest = split.groupBy("team", scale.CHUNK).count().agg(F.max("count")).first()[0]
    period = skewed.groupBy("team", "season", "week").count().agg(F.max("count")).first()[0]
    assert largest <= 20 + period + 2


def games(spark, n=240):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        home = "A" if i % 3 else f"T{rng.randrange(5)}"
        away = f"U{rng.randrange(5)}" if i % 2 else f"T{rng.randrange(5, 9)}"
        score = (None, None) if i % 17 == 0 else (rng.randrange(40), rng.randrange(40))
        season, day = 2020 + i // 60, i % 60 // 4
        rows.append((i, season, day // 2 + 1, f"{season}-09-{day + 1:02d}", home, away, *score, (i % 15 - 7) / 2))
    df = spark.createDataFrame(rows, "game_id int, season int, week int, gameday string, home_team string, away_team string, home_score int, away_score int, home_line double")
    return df.withColumn("gameday", F.to_date("gameday"))


@pytest.mark.parametrize("make", [
    lambda g, c: recent_form(g, chunk_rows=c).drop("gameday"),
    lambda g, c: rest_days(g, chunk_rows=c).drop("gameday"),
    lambda g, c: team_feature_frame(g, chunk_rows=c).drop("gameday"),
])
def test_game_windows_do_not_depend_on_chunks(spark, make):
    g = games(spark)
    plain, split, seasons = make(g, 10**9), make(g.repartition(5), 6), make(g.repartition(3), None)
    want = sorted(map(str, plain.collect()))
    for other in (split, seasons):
        assert want == sorted(map(str, other.select(plain.columns).collect()))


def test_no_job_runs_while_a_plan_is_built(spark, sf_dir):
    from hashmark.catalog.bindings import games as bound_games, supplier_ratings, team_week

    ratings = supplier_ratings(spark, sf_dir).groupBy("team").agg(F.max("rating").alias("epa_off"), F.min("rating").alias("epa_def"))
    g, stats = bound_games(spark, sf_dir), team_week(spark, sf_dir)
    spark.sparkContext.setJobGroup("plans only", "no jobs")
    try:
        recent_form(g), rest_days(g), team_feature_frame(g, stats, ratings), matchup_features(g, ratings)
        rolling_multi(stats, {"epa": "off_epa_per_play"}), attach_season_means(g, stats.select("team", "season", F.col("off_epa_per_play").alias("epa_margin")))
        started = spark.sparkContext.statusTracker().getJobIdsForGroup("plans only")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(started) == 0


def test_running_total_and_position(spark, skewed):
    df = skewed.withColumn("x", F.coalesce("x", F.lit(0.0)))
    got = scale.running_total(df, ["team"], ["season", "week"], ["game_id"], "x", "total")
    base = Window.partitionBy("team").orderBy("season", "week", "game_id")
    want = df.withColumn("total", F.sum("x").over(base))
    assert sorted(got.select("game_id", "total").collect()) == sorted(want.select("game_id", "total").collect())
    placed = scale.global_position(df, ["season", "week"], ["game_id"])
    order = [r.game_id for r in placed.orderBy("position").collect()]
    assert order == [r.game_id for r in df.orderBy("season", "week", "game_id").collect()]
    assert placed.first()["total"] == 600


@pytest.mark.parametrize("text", [False, True])
def test_one_period_with_all_rows_is_cut(spark, text):
    """One exchange deals a period with all rows over many ranges, also where the order is text; the source is read twice."""
    rng = random.Random(5)
    rows = [("m", 2024, 1, k, rng.randrange(100)) for k in rng.sample(range(1000, 10_000), 500)] + [("m", 2023, 9, None, 3), ("k", 2024, 1, 5000, 7)]
    df = spark.createDataFrame(rows, "model string, season int, week int, game_id int, x int")
    if text:
        df = df.withColumn("game_id", F.col("game_id").cast("string"))
    adaptive, parts = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        sizes = [r["count"] for r in scale.in_ranges(df, ["season", "week", "game_id"], "t").groupBy(scale.PART).count().collect()]
        assert len(sizes) >= 14 and max(sizes) < 80
        order = sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3] or -1))
        totals, so_far = {}, {}
        for r in order:
            so_far[r[0]] = so_far.get(r[0], 0) + r[4]
            totals[r[0], None if r[3] is None else str(r[3])] = so_far[r[0]]
        result = scale.running_total(df, ["model"], ["season", "week"], ["game_id"], "x", "t")
        assert {(r.model, None if r.game_id is None else str(r.game_id)): r.t for r in result.collect()} == totals
        assert result.columns == [*df.columns, "t"]
        placed = scale.global_position(df, ["season", "week"], ["game_id", "model"]).collect()
        by = sorted(rows, key=lambda r: (r[1], r[2], r[3] or -1, r[0]))
        assert {(r.position, r.total, r.model, r.x) for r in placed} == {(k, 502, r[0], r[4]) for k, r in enumerate(by)}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_running_total_of_nothing(spark):
    empty = spark.createDataFrame([], "model string, season int, week int, game_id int, x int")
    assert scale.running_total(empty, ["model"], ["season", "week"], ["game_id"], "x", "t").collect() == []
    assert scale.global_position(empty, ["season", "week"], ["game_id"]).collect() == []


@pytest.mark.parametrize("accuracy, max_keys, band_rows", [(20_000, 10_000, 10**6), (20, 10_000, 10**6), (20, 10_000, 1), (50, 1, 10**6)])
def test_percentiles_are_exact(spark, skewed, accuracy, max_keys, band_rows):
    wanted = {"p0": 0.0, "q1": 0.25, "med": 0.5, "p99": 0.99, "top": 1.0}
    got = scale.exact_percentiles(skewed, ["team"], "x", wanted, {"n": F.count("*")}, accuracy=accuracy, max_keys=max_keys, band_rows=band_rows)
    found = {r.team: r for r in got.collect()}
    data = skewed.toPandas()
    assert set(found) == set(data.team)
    for team, part in data.groupby("team"):
        assert found[team].n == len(part)
        for name, p in wanted.items():
            assert found[team][name] == pytest.approx(np.nanpercentile(part.x.astype(float), p * 100)), (team, name)


def test_percentiles_without_keys_and_with_heavy_ties(spark):
    df = spark.range(4001).select(F.when(F.col("id") % 3 == 0, F.lit(1.0)).otherwise(F.col("id") * 1.5).alias("v"))
    row = scale.exact_percentiles(df, [], "v", {"m": 0.5}, accuracy=100).first()
    values = [1.0 if i % 3 == 0 else i * 1.5 for i in range(4001)]
    assert row["m"] == pytest.approx(float(np.median(values)))


def test_percentiles_of_an_empty_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None)], "k string, v double")
    rows = {r.k: r.m for r in scale.exact_percentiles(df, ["k"], "v", {"m": 0.5}).collect()}
    assert rows == {"a": 1.5, "b": None}


def test_null_keys_join_back(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    sums = df.groupBy("k").agg(F.sum("v").alias("s"))
    assert sorted(r.s for r in scale.join_back(df, sums, ["k"]).collect()) == [1, 2]
