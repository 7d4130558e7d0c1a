"""Percentiles of overlapping groups and of many columns, and as-of quotes, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hashmark.operators import market, ranks, reports


@pytest.fixture(scope="module")
def bets(spark):
    rng = random.Random(11)
    rows = []
    for i in range(1500):
        edge = None if i % 41 == 0 else rng.choice([0.0, 0.5, 1.0, -2.0, rng.gauss(0, 3)])
        kelly = None if i % 37 == 0 else (0.25 if i % 3 == 0 else round(abs(rng.gauss(0, 0.1)), 3))
        rows.append((i, edge, None if edge is None else abs(edge), kelly, rng.gauss(1, 5), "train" if i % 5 else None if i % 25 == 0 else "test"))
    return spark.createDataFrame(rows, "id int, edge double, abs_edge double, kelly_quarter double, ev_dollars double, data_split string").repartition(7)


def _median(values):
    values = [v for v in values if v is not None]
    return float(np.median(values)) if values else None


@pytest.mark.parametrize("band_rows, accuracy, grid", [(10**6, 20_000, 1000), (1, 20_000, 1000), (1, 40, 8), (10**6, 100, 20)])
def test_kelly_medians(bets, monkeypatch, band_rows, accuracy, grid):
    monkeypatch.setattr(ranks, "ACCURACY", accuracy)
    monkeypatch.setattr(ranks, "GRID", grid)
    monkeypatch.setattr(ranks.percentiles_of_unions, "__defaults__", (band_rows,))
    rows = bets.collect()
    thresholds = [3.0, 0.5, 1.0, 100.0, 2.0]
    found = {r.threshold: r for r in reports.kelly_by_threshold(bets, thresholds).collect()}
    assert set(found) == {0.5, 1.0, 2.0, 3.0}  # nothing reaches 100
    for t, r in found.items():
        k = [x.kelly_quarter for x in rows if x.abs_edge is not None and x.abs_edge >= t]
        filled = [x for x in k if x is not None]
        assert r.bets == len(k) and r.max_kelly == max(filled) and r.median_kelly == pytest.approx(_median(k), abs=1e-12)
        assert r.mean_kelly == pytest.approx(np.mean(filled))


def test_summary(bets):
    rows = bets.collect()
    parts = {("overall", "overall"): rows}
    for s in ("train", "test", None):
        parts["split", s] = [r for r in rows if r.data_split == s]
    for t in (0.5, 2.0):
        parts["threshold", f"{t}+"] = [r for r in rows if r.abs_edge is not None and r.abs_edge >= t]
    found = {(r.scope, r.label): r for r in reports.backtest_summary(bets, [2.0, 0.5]).collect()}
    assert set(found) == set(parts)
    for key, own in parts.items():
        r, sizes = found[key], [x.abs_edge for x in own if x.abs_edge is not None]
        assert (r.n, r.median_abs_edge) == (len(own), pytest.approx(_median(sizes), abs=1e-12))
        assert r.mean_abs_edge == pytest.approx(np.mean(sizes)) and r.rmse == pytest.approx(np.sqrt(np.mean(np.square(sizes))))
        assert r.total_ev == pytest.approx(sum(x.ev_dollars for x in own)) and r.mean_ev == pytest.approx(np.mean([x.ev_dollars for x in own]))


def test_no_rows_give_no_groups(bets):
    assert reports.kelly_by_threshold(bets.limit(0)).collect() == []
    assert reports.kelly_by_threshold(bets.filter("kelly_quarter IS NULL")).select("median_kelly").distinct().collect() == [(None,)]
    assert [tuple(r) for r in reports.describe_columns(bets.limit(0), ["edge"]).collect()] == [("edge", 0, *[None] * 8)]


@pytest.mark.parametrize("band_rows, accuracy", [(10**6, 20_000), (1, 20_000), (1, 30)])
def test_column_quartiles(spark, bets, monkeypatch, band_rows, accuracy):
    monkeypatch.setattr(ranks, "ACCURACY", accuracy)
    monkeypatch.setattr(ranks.percentiles_of_columns, "__defaults__", (band_rows,))
    df = bets.withColumns({"flat": F.lit(3), "none": F.lit(None).cast("double"), "near": F.col("__near") if "__near" in bets.columns else F.col("id") % 4})
    columns = ["edge", "kelly_quarter", "id", "flat", "none", "near"]
    found = {r["column"]: r for r in reports.describe_columns(df, columns).collect()}
    data = {c: [r[c] for r in df.select(c).collect() if r[c] is not None] for c in columns}
    assert set(found) == set(columns)
    for c, values in data.items():
        r = found[c]
        assert r.n == len(values)
        if values:
            want = [float(np.percentile(values, p)) for p in (25, 50, 75)]
            assert [r.q25, r.q50, r.q75] == pytest.approx(want, abs=1e-12)
            assert (r.min, r.max, r.range) == (min(values), max(values), max(values) - min(values)) and r["mean"] == pytest.approx(np.mean(values))
        else:
            assert r.q50 is None and r["mean"] is None


def test_rows_are_not_copied(bets):
    """The second pass has no generator under its first aggregate."""
    for report in (reports.kelly_by_threshold(bets), reports.describe_columns(bets, ["edge", "id"])):
        plan = report._jdf.queryExecution().optimizedPlan().toString().splitlines()
        generators = [i for i, line in enumerate(plan) if "Generate" in line]
        scans = [i for i, line in enumerate(plan) if "Aggregate" in line]
        assert all(any(s > g for s in scans) for g in generators)


@pytest.mark.parametrize("parts", ["3", "40"])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_quotes(spark, strict, parts):
    rng = random.Random(2)
    quotes = [(rng.choice(["hot", "hot", "a", "b", None]), None if i % 31 == 0 else rng.randrange(60), i, float(i), i % 7) for i in range(400)]
    bets = [(rng.choice(["hot", "hot", "a", "c", None]), None if i % 23 == 0 else rng.randrange(-3, 64), i % 90) for i in range(300)]
    q = spark.createDataFrame(quotes, "game_id string, ts int, event_id int, line double, odds int").repartition(5)
    b = spark.createDataFrame(bets, "game_id string, at int, bet int").repartition(3)
    before, coalesce = (spark.conf.get(f"spark.sql.{k}") for k in ("shuffle.partitions", "adaptive.coalescePartitions.enabled"))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = market.asof_quotes(b, q, bet_ts="at", tie_break=["event_id"], columns=["line", "odds"], strict=strict)
        got = sorted(map(tuple, found.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)

    def newest(game, at):
        open_ = [x for x in quotes if None not in (game, at, x[1]) and x[0] == game and (x[1] < at or x[1] == at and not strict)]
        return max(open_, key=lambda x: (x[1], x[2]))[3:] if open_ else (None, None)

    assert got == sorted(((g, at, n, *newest(g, at)) for g, at, n in bets), key=str)
    assert found.columns == ["game_id", "at", "bet", "asof_line", "asof_odds"]


def test_price_code_is_short_enough_to_be_compiled(spark, sf_dir, capsys):
    """A method of more than 8,000 bytes stays interpreted."""
    import re

    from hashmark.catalog import QUERIES

    for name in ("price_quotes", "bet_sizing"):
        QUERIES[name](spark, sf_dir).explain("codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
        assert sizes and max(sizes) < 8000, name
