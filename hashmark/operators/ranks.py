"""Exact percentiles of groups that overlap, and of many columns, without a copy of any row.

Rows of one cell (an interval between thresholds, a split) belong to the same groups, so figures, sketches and histograms are
taken per cell and those of a group are merged from its cells.  Each frame is read twice: once for figures and a sketch that
brackets every wanted rank, once for the counts around the brackets.  Only figures per cell reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from hashmark.operators.scale import BAND_SLICES, CHUNK_ROWS, join_back, percentiles_from_counts

ACCURACY = 20_000
#: Points of a cell's sketch.
GRID = 1000
MAX_CELLS = 10_000
MERGE: Mapping[str, Callable] = {"sum": sum, "max": max, "min": min}


def percentiles_of_unions(
    df: DataFrame,
    cells: Mapping[str, Column],
    value: str,
    percentages: Mapping[str, float],
    parts: Callable[[Row], Sequence[tuple]],
    part_schema: str,
    figures: Mapping[str, tuple[str, Column]],
    band_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Percentiles and ``figures`` of groups that are unions of cells.

    ``cells`` are the columns that tell rows of different cells apart; ``parts`` names the groups of a cell (as tuples of
    ``part_schema``), ``figures`` are aggregates with the way to merge them (``sum``, ``max`` or ``min``).  Groups without rows
    do not appear.  There may be ``MAX_CELLS`` cells at most; more are an error.
    """
    spark, names = df.sparkSession, [field.split()[0] for field in part_schema.split(",")]
    rows = df.select(*[c.alias(n) for n, c in cells.items()], F.col(value).cast("double").alias("__v"), *_inputs(df, cells))
    v = F.col("__v")
    grid = [k / GRID for k in range(GRID + 1)]
    first = rows.groupBy(*cells).agg(
        *[c.alias(n) for n, (_, c) in figures.items()], F.count(v).alias("__n"), F.percentile_approx(v, grid, ACCURACY).alias("__q"),
        F.min(v).alias("__lo"), F.max(v).alias("__hi"),
    )
    local = first.limit(MAX_CELLS + 1).collect()
    if len(local) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells")
    members: dict[tuple, list[Row]] = {}
    for row in local:
        for part in parts(row):
            members.setdefault(tuple(part), []).append(row)

    merged, wanted = [], []
    for part, own in members.items():
        values = [[r[n] for r in own if r[n] is not None] for n in figures]
        merged.append((*part, *[MERGE[how](x) if x else None for x, (how, _) in zip(values, figures.values())]))
        filled = [r for r in own if r["__n"]]
        if filled:
            total = sum(r["__n"] for r in filled)
            for name, p in percentages.items():
                rank = p * (total - 1)
                low, high = _bracket(filled, int(np.floor(rank)), int(np.ceil(rank)))
                wanted += [(*[r[c] for c in cells], *part, name, rank, low, high) for r in filled]
    kinds = {f.name: f.dataType.simpleString() for f in first.schema.fields}
    figure_schema = ", ".join([part_schema, *[f"`{n}` {kinds[n]}" for n in figures]])
    known = spark.createDataFrame(merged, figure_schema)
    if not wanted:
        return known.select(*names, *figures, *[F.lit(None).cast("double").alias(n) for n in percentages])

    # a value is counted by itself inside a bracket, otherwise with all others between two edges of brackets
    edges = sorted({x for w in wanted for x in w[-2:]})
    zone = reduce(lambda acc, e: acc + (v > e).cast("int") + (v >= e).cast("int"), edges, F.lit(0))
    bands = _merged(sorted({w[-2:] for w in wanted}))
    inside = reduce(lambda acc, b: acc | v.between(*b), bands, F.lit(False))
    span = reduce(lambda acc, b: acc.when(v.between(*b), F.floor((v - b[0]) / (b[1] - b[0]) * BAND_SLICES) if b[1] > b[0] else F.lit(0)), bands, F.when(F.lit(False), 0))
    # NULLs go after the aggregate: a filter on the value would be pushed into the scan with all that the value is made of
    keyed = rows.select(*cells, zone.alias("__z"), F.when(inside, span.cast("int")).alias("__slice"), F.when(inside, v).alias("__in"), "__v")
    counted = keyed.groupBy(*cells, "__z", "__slice", "__in").agg(F.count("*").alias("__c"), F.max("__v").alias("__max"), F.min("__v").alias("__min"))
    counted = counted.filter(F.col("__max").isNotNull())

    cell_schema = ", ".join(f"`{c}` {kinds[c]}" for c in cells)
    members_frame = spark.createDataFrame(wanted, f"{cell_schema}, {part_schema}, __name string, __rank double, __from double, __to double")
    met = join_back(counted, F.broadcast(members_frame), list(cells), "inner")
    at = F.when(F.col("__max") < F.col("__from"), -1).when(F.col("__min") > F.col("__to"), 1).otherwise(0)
    met = met.withColumn("__zone", at).withColumns({c: F.when(F.col("__zone") == 0, F.col(c)) for c in ("__slice", "__in")})
    counted = met.groupBy(*names, "__name", "__rank", "__zone", "__slice", "__in").agg(
        F.sum("__c").alias("__c"), F.max("__max").alias("__max"), F.min("__min").alias("__min")
    )
    sliced = max(r["__n"] for r in local) * 4 / GRID > band_rows
    exact = percentiles_from_counts(counted, names, list(percentages), sliced)
    return join_back(known, exact, names).select(*names, *figures, *percentages)


def _inputs(df: DataFrame, cells: Mapping[str, Column]) -> list[str]:
    """The frame's own columns, for figures to be computed from; a cell column replaces one of its name."""
    return [c for c in df.columns if c not in cells]


def _merged(bands: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    """Sorted intervals without overlaps."""
    out: list[tuple[float, float]] = []
    for low, high in bands:
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _bracket(cells: Sequence[Row], floor: int, ceil: int) -> tuple[float, float]:
    """Values between which the order statistics ``floor`` to ``ceil`` of the cells' union lie.

    A sketch's point at share s has a rank within ``1 / ACCURACY`` of ``s`` times the count, so the points on either side of a
    value bound how many values of the cell lie below it.
    """
    points = np.unique(np.concatenate([np.array([*r["__q"], r["__lo"], r["__hi"]], dtype=float) for r in cells]))
    at_most, at_least = np.zeros(len(points)), np.zeros(len(points))
    for r in cells:
        own, n = np.array(r["__q"], dtype=float), r["__n"]
        slack = n / ACCURACY + 1
        under = np.searchsorted(own, points, side="left")  # the first point that is not smaller
        at_most += np.where(points > r["__hi"], n, np.where(points <= r["__lo"], 0, np.minimum(n, under / GRID * n + slack)))
        upto = np.searchsorted(own, points, side="right") - 1  # the last point that is not larger
        at_least += np.where(points >= r["__hi"], n, np.maximum(0, upto / GRID * n - slack))
    below, above = np.flatnonzero(at_most <= floor), np.flatnonzero(at_least >= ceil + 1)
    return float(points[below[-1]] if len(below) else points[0]), float(points[above[0]] if len(above) else points[-1])


def percentiles_of_columns(
    df: DataFrame, columns: Sequence[str], percentages: Mapping[str, float], figures: Mapping[str, Callable[[Column], Column]], band_rows: int = CHUNK_ROWS
) -> DataFrame:
    """One row per column with ``figures`` of it and exact percentiles.

    The second pass groups rows by the values that lie inside some bracket, which is no value for nearly all rows: those are
    one group in each task, whose counts below and above every bracket are plain conditional aggregates.
    """
    spark, values = df.sparkSession, {c: F.col(c).cast("double") for c in columns}
    margin = 3.0 / ACCURACY
    shares = [b for p in percentages.values() for b in (max(0.0, p - margin), min(1.0, p + margin))]
    row = df.agg(*[
        aggregate.alias(f"{label}{i}")
        for i, v in enumerate(values.values())
        for label, aggregate in (("n", F.count(v)), ("b", F.percentile_approx(v, shares, ACCURACY)), ("lo", F.min(v)), ("hi", F.max(v)),
                                 *[(f"f{j}_", f(v)) for j, f in enumerate(figures.values())])
    ])
    kinds = [row.schema[f"f{j}_0"].dataType.simpleString() for j in range(len(figures))] if columns else []
    found = row.first()
    known = spark.createDataFrame(
        [(c, *[found[f"f{j}_{i}"] for j in range(len(figures))]) for i, c in enumerate(columns)],
        ", ".join(["column string", *[f"`{n}` {k}" for n, k in zip(figures, kinds)]]) if columns else "column string",
    )
    bands = []
    for i, c in enumerate(columns):
        for k, (name, p) in enumerate(percentages.items()):
            if found[f"n{i}"]:
                low = found[f"lo{i}"] if shares[2 * k] == 0.0 else found[f"b{i}"][2 * k]
                high = found[f"hi{i}"] if shares[2 * k + 1] == 1.0 else found[f"b{i}"][2 * k + 1]
                bands.append((c, name, p * (found[f"n{i}"] - 1), low, high))
    if not bands:
        return known.select("*", *[F.lit(None).cast("double").alias(n) for n in percentages])

    def entry(b: int, v: Column, low: float, high: float) -> Column:
        share = F.floor((v - low) / (high - low) * BAND_SLICES).cast("int") if high > low else F.lit(0)
        return F.struct(F.lit(b).alias("__band"), share.alias("__slice"), v.alias("__in"))

    # a bracket of one value is a count; only values of wider ones are listed
    hits = [values[c].between(low, high) & F.lit(low < high) for c, _, _, low, high in bands]
    entries = F.array(*[F.when(hit, entry(b, values[c], low, high)) for b, (hit, (c, _, _, low, high)) in enumerate(zip(hits, bands))])
    near = reduce(lambda acc, hit: acc | hit, [F.coalesce(hit, F.lit(False)) for hit in hits])
    counts = []
    for b, (c, _, _, low, high) in enumerate(bands):
        v = values[c]
        counts += [
            F.count_if(v < low).alias(f"u{b}"), F.max(F.when(v < low, v)).alias(f"um{b}"),
            F.count_if(v > high).alias(f"o{b}"), F.min(F.when(v > high, v)).alias(f"om{b}"),
            *([F.count_if(v == low).alias(f"e{b}"), F.lit(low).alias(f"em{b}")] if low == high else []),
        ]
    grouped = df.groupBy(F.when(near, F.array_compact(entries)).alias("__near")).agg(F.count("*").alias("__rows"), *counts)

    def side(b: int, zone: int, count: str, edge: str) -> Column:
        at = (F.lit(0), F.col(edge)) if zone == 0 else (F.lit(None).cast("int"), F.lit(None).cast("double"))
        return F.struct(
            F.lit(b).alias("__band"), F.lit(zone).alias("__zone"), at[0].alias("__slice"), at[1].alias("__in"),
            F.col(count).alias("__c"), F.col(edge).alias("__edge"),
        )

    sides = [side(b, zone, f"{s}{b}", f"{s}m{b}") for b in range(len(bands)) for zone, s in ((-1, "u"), (1, "o"))]
    sides += [side(b, 0, f"e{b}", f"em{b}") for b, (_, _, _, low, high) in enumerate(bands) if low == high]
    centre = F.transform(
        F.coalesce("__near", F.array()),
        lambda x: F.struct(x["__band"].alias("__band"), F.lit(0).alias("__zone"), x["__slice"].alias("__slice"), x["__in"].alias("__in"), F.col("__rows").alias("__c"), x["__in"].alias("__edge")),
    )
    # groups, not rows, are unfolded here: one in each task and those that hold values inside a bracket
    outside = F.filter(F.array(*sides), lambda x: x["__c"] > 0)
    counted = grouped.select(F.inline(F.concat(outside, centre))).groupBy("__band", "__zone", "__slice", "__in").agg(
        F.sum("__c").alias("__c"), F.max("__edge").alias("__max"), F.min("__edge").alias("__min")
    )
    which = spark.createDataFrame([(b, c, name, rank) for b, (c, name, rank, _, _) in enumerate(bands)], "__band int, column string, __name string, __rank double")
    counted = counted.join(F.broadcast(which), "__band").drop("__band")
    sliced = max(found[f"n{i}"] for i in range(len(columns))) * 2 * margin > band_rows
    exact = percentiles_from_counts(counted, ["column"], list(percentages), sliced)
    return join_back(known, exact, ["column"]).select("column", *figures, *percentages)
