"""Snapshot files with every irregularity, table scans, sinks and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hashmark.catalog.bindings import plays
from hashmark.operators.periods import team_period_stats
from hashmark.session import scratch_path, shared_dir
from hashmark.sources import sinks, snapshots, tables
from hashmark.sources.franchises import franchise_aliases


@pytest.fixture()
def folder(tmp_path):
    files = {
        "power_ratings_one_2025_week_11.csv": "Team,Season,nfelo,QB Adj,Value,Play,Pass,Play\nLAR,2025,1674.78,27.5,7.3,0.1,0.2,0.3\nDET,2025,1674.34,9.2,7.3,0.4,0.5,0.6\n",
        "one_power_ratings_2025_week_11.csv": "Team,nfelo\nLAR,1\n",
        "one_power_ratings_2025_week_10.csv": "Team,nfelo\nLAR,1600\n",
        "power_ratings_two_2025_week_11.csv": "﻿X.1,X.2,~~~Ratings~~~,X.3,X.4\nTeam,Div.,Off.,Def.,Ovr.\nRams,NFCW,3.9,4.8,8.7\nChiefs,AFCW,1.9,4.8,6.7\nNobody,AFCW,1,1,1\n",
        "qb_epa_two_2025_week_11.csv": "﻿X.2,X.4,X.6,X.9,~~~Per 17 Gms~~~\nPlayer,Age,Tms,Plays,EPA\nA,29,ram,300,10\nB,30,\"ram, cin\",20,99\nC,24,kan,250,7\n",
        "epa_tiers_one_2025_week_11.csv": "Team,Season,EPA/Play,EPA/Play Against\nLAR,2025,0.2,-0.1\nKC,2025,0.1,\n",
        "two_weekly_proj_ppg_2025_week_11.csv": "Date,Time (ET),Matchup,Favorite,Win Prob.\n2025-11-16,1:00PM,Rams vs Chiefs,LAR PK,50.6\n",
        "notes.txt": "ignored",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_power_ratings(spark, folder):
    got = snapshots.power_ratings(spark, folder, franchise_aliases(spark)).collect()
    rows = {(r.provider, r.week, r.team): r for r in got}
    assert set(rows) == {("one", 11, "LAR"), ("one", 11, "DET"), ("one", 10, "LAR"), ("two", 11, "LAR"), ("two", 11, "KC")}
    assert rows["one", 11, "LAR"].rating == 1674.78 and rows["one", 11, "LAR"].qb_adj == 27.5 and not rows["one", 11, "LAR"].legacy
    assert rows["one", 10, "LAR"].legacy and rows["two", 11, "KC"].overall == 6.7


def test_passers_and_tiers_and_projections(spark, folder):
    aliases = franchise_aliases(spark)
    passers = snapshots.qb_epa(spark, folder, aliases)
    assert sorted((r.team, r.player, r.plays) for r in passers.collect()) == [("KC", "C", 250), ("LAR", "A", 300), ("LAR", "B", 20)]
    tiers = {r.team: r for r in snapshots.epa_tiers(spark, folder, aliases).collect()}
    assert tiers["LAR"].epa_margin == pytest.approx(0.3) and tiers["KC"].epa_def is None
    projected = snapshots.weekly_projections(spark, folder).first()
    assert (projected.matchup, projected.favorite_line, projected.team, projected.legacy) == ("Rams vs Chiefs", "LAR PK", None, True)


def test_load_sources(spark, folder):
    wanted = [("power_ratings", "one"), ("epa_tiers", "one"), ("power_ratings", "two"), ("qb_epa", "two"),
              ("weekly_projections_ppg", "two"), ("strength_of_schedule", "one")]
    merged, skipped = snapshots.load_sources(spark, folder, 2025, 11, wanted, franchise_aliases(spark))
    rows = {r.team: r for r in merged.collect()}
    assert set(rows) == {"LAR", "DET"} and rows["LAR"].player == "A" and rows["DET"].epa_off is None
    assert [name for name, _ in skipped] == ["weekly_projections_ppg_two", "strength_of_schedule_one"]
    with pytest.raises(ValueError, match="base source"):
        snapshots.load_sources(spark, folder, 2025, 3, wanted, franchise_aliases(spark))


def test_completeness(spark, folder):
    found = snapshots.power_ratings(spark, folder)
    got = snapshots.source_completeness(found, [("power_ratings", "one", True), ("power_ratings", "two", True)]).collect()
    weeks = {(r.week, r.provider): (r.ok, r.week_complete) for r in got}
    assert weeks == {(11, "one"): (True, True), (11, "two"): (True, True), (10, "one"): (True, False), (10, "two"): (False, False)}


def test_unknown_suffix_and_missing_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="neither"):
        tables.read_table(spark, str(tmp_path / "x.xlsx"))
    path = str(tmp_path / "p.parquet")
    spark.range(3).write.parquet(path)
    with pytest.raises(ValueError, match="lacks"):
        tables.scan_plays(spark, path)


def test_season_range_prunes_partitions(spark, sf_dir, tmp_path):
    path = str(tmp_path / "plays")
    sinks.repack_plays(plays(spark, sf_dir), path)
    text = tables.select_games(tables.read_table(spark, path), 1997, 1998)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in text


def test_shared_dir_follows_the_session(spark):
    class Conf:
        def get(self, key, default=None):
            return "/shared/named-by-the-cluster" if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert shared_dir(Session()) == "/shared/named-by-the-cluster"
    assert scratch_path(Session(), "x").startswith("/shared/named-by-the-cluster/hashmark/x-")
    own = shared_dir(spark)
    assert own == shared_dir(spark)


def _sorted(df):
    """Rows as text, floats rounded a little off the exact halves that two-decimal inputs produce."""
    rounded = [F.bround(F.col(c) + 1.23e-9, 6).alias(c) if t == "double" else F.col(c) for c, t in sorted(df.dtypes)]
    return sorted(map(str, df.select(*rounded).collect()))


def test_scratch_paths_differ(spark):
    assert scratch_path(spark, "a") != scratch_path(spark, "a")


def test_files_of_any_width_and_provider(spark, tmp_path):
    wide = ",".join(f"c{i}" for i in range(71))
    (tmp_path / "power_ratings_my_prov_2025_week_1.csv").write_text(f"Team,{wide},nfelo\nLAR,{wide},1650\nBUF,,\n\nKC,{wide},1700\n")
    (tmp_path / "power_ratings-2025.csv").write_text("Team,nfelo\nLAR,1\n")
    (tmp_path / "quoted_power_ratings_2025_week_2.csv").write_text('title,"a, b"\nTeam,note,nfelo\nLAR,"x, ""y""",1.5\n')
    got = {(r.provider, r.team): r.rating for r in snapshots.power_ratings(spark, str(tmp_path)).collect()}
    assert got == {("my_prov", "LAR"): 1650.0, ("my_prov", "BUF"): None, ("my_prov", "KC"): 1700.0, ("quoted", "LAR"): 1.5}
    assert [p.rsplit("/", 1)[-1] for p in snapshots.unmatched_files(spark, str(tmp_path))] == ["power_ratings-2025.csv"]


def test_text_columns_of_team_weeks_stay_text(spark, tmp_path):
    rows = [(2024, 1, "LAR", "REG", "0.25"), (2024, 1, "KC", "REG", "n/a")]
    spark.createDataFrame(rows, "season int, week int, team string, season_type string, off_epa_per_play string").write.parquet(str(tmp_path / "tw"))
    got = {r.team: (r.season_type, r.off_epa_per_play) for r in tables.scan_team_week(spark, str(tmp_path / "tw")).collect()}
    assert got == {"LAR": ("REG", 0.25), "KC": ("REG", None)}


def test_presence_terms_reach_the_reader(spark, tmp_path):
    rows = [("2024_01_KC_LAR", 1.0, 2.0, 3.0), ("2024_01_DET_SF", float("nan"), 2.0, 3.0), ("2024_02_KC_SF", None, 2.0, 3.0)]
    spark.createDataFrame(rows, "game_id string, home_line double, rating_home double, rating_away double").write.parquet(str(tmp_path / "rated"))
    scan = tables.scan_rated_games(spark, str(tmp_path / "rated"))
    plan = scan._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    assert all(f"IsNotNull({c})" in pushed for c in ("home_line", "rating_home", "rating_away"))
    assert [r.game_id for r in scan.collect()] == ["2024_01_KC_LAR"]


def test_a_cluster_needs_a_shared_folder(spark):
    class Cluster:
        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster)


def test_upsert_reads_and_replaces_touched_partitions_only(spark, tmp_path):
    from hashmark.sources import sinks

    path, schema = str(tmp_path / "t"), "season int, week int, team string, x int"
    old = [(s, w, t, 10 * w) for s in (2020, 2021, None) for w in (1, 2) for t in ("a", "b")]
    spark.createDataFrame(old, schema).write.partitionBy("season").parquet(path)

    def files():
        return {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}

    before = files()
    new = [(2021, 2, "a", -1), (2021, 2, "a", -2), (2021, 3, "c", 5), (2022, 1, "a", 7)]
    sinks.upsert_partitions(spark.createDataFrame(new, schema), path, ["season", "week", "team"], ["x"])
    want = {r[:3]: r[3] for r in old} | {(2021, 2, "a"): -1, (2021, 3, "c"): 5, (2022, 1, "a"): 7}
    got = spark.read.schema(schema).parquet(path).select("season", "week", "team", "x").collect()
    assert {tuple(r)[:3]: r.x for r in got} == want and len(got) == len(want)
    kept = {p: t for p, t in before.items() if "season=2020" in p or "HIVE_DEFAULT" in p}
    assert kept and kept.items() <= files().items()
    sinks.upsert_partitions(spark.createDataFrame([], schema), path, ["season", "week", "team"])
    assert kept.items() <= files().items()
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    touched = sinks.touched_partitions(spark.read.parquet(path), spark.createDataFrame(new, schema).select("season").distinct().collect(), ["season"])
    assert "PartitionFilters: [season" in touched._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    with pytest.raises(ValueError, match="not part of the keys"):
        sinks.upsert_partitions(spark.createDataFrame(new, schema), path, ["week", "team"])
