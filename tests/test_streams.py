"""Streams against batches: late, restated and replayed data, state that ends, change tables that stay small."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hashmark.catalog.bindings import plays as bound_plays
from hashmark.operators.periods import team_period_stats
from hashmark.streaming import incremental


def _same(a, b):
    columns = b.columns
    rounded = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in b.dtypes]
    return sorted(map(str, a.select(columns).select(rounded).collect())) == sorted(map(str, b.select(rounded).collect()))


def _run(spark, source, schema, out, check, **how):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    incremental.stream_upsert_periods(stream, f"{out}/state", f"{out}/target", check, **how).awaitTermination()
    return incremental.read_periods(spark, f"{out}/target")


@pytest.fixture(scope="module")
def plays(spark, sf_dir):
    return bound_plays(spark, sf_dir).filter("season IN (1995, 1996)").cache()


def test_late_plays_add_to_their_week_and_replays_change_nothing(spark, plays, tmp_path):
    source = str(tmp_path / "in")
    late = (F.col("game_id") % 3 == 0)
    plays.filter(~late).coalesce(1).write.parquet(source)
    got = _run(spark, source, plays.schema, tmp_path, f"{tmp_path}/check")
    assert _same(got, team_period_stats(plays.filter(~late)))
    plays.filter(late & (F.col("season") == 1995)).coalesce(1).write.mode("append").parquet(source)
    plays.filter(late & (F.col("season") != 1995)).coalesce(1).write.mode("append").parquet(source)
    got = _run(spark, source, plays.schema, tmp_path, f"{tmp_path}/check")
    assert _same(got, team_period_stats(plays))
    # the same files once more from the first batch on: every batch writes what it wrote before
    assert _same(_run(spark, source, plays.schema, tmp_path, f"{tmp_path}/check-again"), team_period_stats(plays))


def test_a_late_play_rewrites_one_week(spark, plays, tmp_path):
    source = str(tmp_path / "in")
    plays.coalesce(1).write.parquet(source)
    _run(spark, source, plays.schema, tmp_path, f"{tmp_path}/check")

    def files():
        return {str(p.relative_to(tmp_path)): p.stat().st_mtime_ns for p in (tmp_path / "target").rglob("*.parquet")}

    before = files()
    plays.filter("season = 1995 AND week = 3").limit(1).coalesce(1).write.mode("append").parquet(source)
    _run(spark, source, plays.schema, tmp_path, f"{tmp_path}/check")
    after = files()
    changed = {p.rsplit("/", 1)[0] for p, _ in set(before.items()) ^ set(after.items())}
    assert changed == {"target/season=1995/week=3"}
    touched = incremental.touched_parts(spark, f"{tmp_path}/state", 1, False)
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)  # filters are cut short otherwise
    plan = touched._jdf.queryExecution().executedPlan().toString()
    pruned = [line for line in plan.splitlines() if "PartitionFilters" in line and "season" in line.split("PartitionFilters")[1]]
    assert pruned and all("1995" in line.split("PartitionFilters")[1] for line in pruned)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert {tuple(r) for r in touched.select("season", "week").distinct().collect()} == {(1995, 3)}


def test_a_restated_week_withdraws_what_was_there(spark, plays, tmp_path):
    source = str(tmp_path / "in")
    week = (F.col("season") == 1995) & (F.col("week") == 3)
    gone = (F.col("season") == 1995) & (F.col("week") == 4)
    plays.coalesce(1).write.parquet(source)
    _run(spark, source, plays.schema, tmp_path, f"{tmp_path}/check", restated=True)
    fewer = plays.filter(week & (F.col("game_id") % 2 == 0))
    empty = plays.filter(gone).withColumn("play_type", F.lit("no_play"))  # nothing of the week is left
    fewer.unionByName(empty).coalesce(1).write.mode("append").parquet(source)
    got = _run(spark, source, plays.schema, tmp_path, f"{tmp_path}/check", restated=True)
    assert _same(got, team_period_stats(plays.filter(~week & ~gone).unionByName(fewer)))


def test_closing_quotes_leave_the_state_at_kickoff(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    schema = "game_id int, ts timestamp, event_id int, line double, kickoff timestamp"
    source = str(tmp_path / "in")
    # ten games begin an hour apart; quotes come in the order of time, one file for every two hours, some after kickoff, and ties
    rows = []
    for minute in range(0, 16 * 60, 10):
        for game in range(10):
            kickoff = at + dt.timedelta(hours=2 + game)
            rows.append((game, at + dt.timedelta(minutes=minute - minute % 20), minute * 10 + game, float(minute + game), kickoff))
    rows.append((None, at, 1, 1.0, at))
    rows.append((99, at, 1, 1.0, None))
    for k in range(8):
        part = [r for r in rows if k * 2 <= (r[1] - at).total_seconds() / 3600 < k * 2 + 2]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{source}/f{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    closing = incremental.stream_closing_quote(stream, "kickoff", tie_break=["event_id"], delay="10 minutes")
    query = closing.writeStream.outputMode("append").format("memory").queryName("closing").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(state) == 10 and state[-1] == 0 and any(0 < s < 10 for s in state)
    want = {}
    for game, ts, event, line, kickoff in rows:
        if None not in (game, kickoff) and ts <= kickoff:
            want[game] = max(want.get(game, ((dt.datetime.min, 0), 0.0)), ((ts, event), line))
    got = [(r.game_id, r.ts, r.line) for r in spark.table("closing").collect()]
    assert sorted(got) == sorted((g, key[0], line) for g, (key, line) in want.items())


def test_change_tables_are_folded(spark, tmp_path):
    schema = "game_id int, ts timestamp, line double"
    source, target = str(tmp_path / "in"), tmp_path / "out"
    at = dt.datetime(2024, 1, 1)
    newest = {}

    def more(k):
        rows = [(g, at + dt.timedelta(hours=k), float(k * 10 + g)) for g in range(k % 4, 6)]
        newest.update({r[0]: r for r in rows})
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        latest = incremental.stream_latest_quote(stream)
        incremental.start_upsert_table(latest, str(target), f"{tmp_path}/check", keys=["game_id"], every=3).awaitTermination()
        current = incremental.read_upserted(incremental.read_changes(spark, str(target)), ["game_id"])
        assert sorted(map(tuple, current.select("game_id", "ts", "line").collect())) == sorted(newest.values())
        return len(incremental.read_changes(spark, str(target)).inputFiles())

    opened = [more(k) for k in range(11)]
    assert max(opened[6:]) <= max(opened[:6])
    assert len([p for p in target.iterdir() if p.name.startswith(("batch=", "fold="))]) <= 8
    with pytest.raises(FileNotFoundError):
        incremental.read_changes(spark, str(tmp_path / "nothing"))


def test_closing_quotes_of_moved_games_and_missing_tie_breaks(spark, tmp_path):
    """Games close at the last kickoff named, late quotes of open games count, and no game costs a call of Python."""
    def at(hours):
        return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)

    schema = "game_id int, ts timestamp, event_id int, line double, kickoff timestamp"
    source = str(tmp_path / "in")
    files = [
        # game 1 is put off from hour 4 to hour 9, game 2 begins at hour 5, game 3 closes with a quote at its kickoff
        [(1, at(1), 1, 1.0, at(4)), (2, at(1), None, 2.0, at(5)), (2, at(1), 7, 2.5, at(5)), (3, at(1), 2, 3.0, at(2)), (3, at(2), None, 3.5, at(2))],
        [(1, at(3), 3, 1.5, at(9)), (2, at(3), 3, None, at(5)), (0, at(4.5), 1, 0.0, at(1))],
        # hours behind the newest quote, but before its kickoff; game 3 has closed
        [(1, at(3.5), 3, 1.8, at(9)), (3, at(1.5), 9, 9.9, at(2))],
        [(1, at(9.5), 4, 9.9, at(9)), (0, at(10), 1, 0.0, at(1))],
    ]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{source}/f{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    closing = incremental.stream_closing_quote(stream, "kickoff", tie_break=["event_id"], delay="10 minutes")
    assert "Python" not in closing._jdf.queryExecution().analyzed().toString() and "Pandas" not in closing._jdf.queryExecution().analyzed().toString()
    query = closing.writeStream.outputMode("append").format("memory").queryName("moved").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(tuple(r) for r in spark.table("moved").collect())
    assert got == [(1, at(3.5), 1.8), (2, at(3), None), (3, at(2), 3.5)]
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 0
