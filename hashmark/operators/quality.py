"""Data quality: contracts, ranges, missing and infinite values, duplicates, pair consistency."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashmark.sources.contracts import Contract

SPREAD_LIMIT = 40.0
REST_LIMIT = 14.0
NUMERIC = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.DecimalType)


def _numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def _infinite(col: Column) -> Column:
    return F.abs(col.cast("double")) == F.lit(float("inf"))


def _rows(one_row: DataFrame, structs: Sequence[Column], schema: str) -> DataFrame:
    """One output row per struct; an empty list gives an empty frame of the schema."""
    if not structs:
        return one_row.sparkSession.createDataFrame([], schema)
    return one_row.select(F.inline(F.array(*structs)))


def check_contract(df: DataFrame, contract: Contract) -> DataFrame:
    """Findings of a contract: non-empty, required and optional columns present, numeric columns numeric.

    ``ok`` is the verdict, ``severity`` is error or warning, and ``filled`` counts the non-NULL values
    of a present column (rows for ``non_empty``).  One aggregate over the columns the contract names.
    """
    named = list(dict.fromkeys([*contract.required, *contract.numeric, *contract.optional]))
    present = [c for c in named if c in df.columns]
    counted = df.agg(F.count("*").alias("__n"), *[F.count(F.col(f"`{c}`")).alias(f"f{i}") for i, c in enumerate(present)])
    filled = {c: F.col(f"f{i}") for i, c in enumerate(present)}

    def finding(check: str, column: str, severity: str, ok: Column, count: Column) -> Column:
        return F.struct(
            F.lit(check).alias("check"), F.lit(column).alias("column"), F.lit(severity).alias("severity"),
            ok.alias("ok"), count.cast("long").alias("filled"),
        )

    numeric = set(_numeric_columns(df))
    rows = [finding("non_empty", "*", "error", F.col("__n") > 0, F.col("__n"))]
    for check, columns, severity in (
        ("required", contract.required, "error"), ("numeric", contract.numeric, "error"), ("optional", contract.optional, "warning"),
    ):
        for c in columns:
            ok = (c in numeric) if check == "numeric" else (c in filled)
            rows.append(finding(check, c, severity, F.lit(ok), filled.get(c, F.lit(0))))
    return counted.select(F.inline(F.array(*rows)))


def enforce_contract(df: DataFrame, contract: Contract) -> DataFrame:
    """The frame itself, or a ValueError naming every missing or non-numeric column or the emptiness."""
    numeric = set(_numeric_columns(df))
    problems = [f"missing column {c}" for c in contract.required if c not in df.columns]
    problems += [f"not numeric: {c}" for c in contract.numeric if c in df.columns and c not in numeric]
    if not problems and df.isEmpty():
        problems.append("no rows")
    if problems:
        raise ValueError(f"{contract.name}: " + "; ".join(problems))
    return df


def range_check(df: DataFrame, columns: Sequence[str] | None = None, limit: float = SPREAD_LIMIT) -> DataFrame:
    """Per column: values beyond the limit, largest absolute value, NULLs and infinities, from one pass.

    Default columns are the numeric ones with ``line`` or ``spread`` in the name.
    """
    numeric = _numeric_columns(df)
    chosen = [c for c in (columns or [c for c in numeric if "line" in c.lower() or "spread" in c.lower()]) if c in df.columns]
    size = {c: F.abs(F.col(c).cast("double")) for c in chosen}
    row = df.agg(
        *[F.count_if(size[c] > limit).alias(f"x{i}") for i, c in enumerate(chosen)],
        *[F.max(size[c]).alias(f"m{i}") for i, c in enumerate(chosen)],
        *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(chosen)],
        *[F.count_if(_infinite(F.col(c))).alias(f"f{i}") for i, c in enumerate(chosen)],
    ) if chosen else df.limit(0)
    return _rows(row, [
        F.struct(
            F.lit(c).alias("column"), F.col(f"x{i}").alias("extreme"), F.col(f"m{i}").alias("max_abs"),
            F.col(f"n{i}").alias("nulls"), F.col(f"f{i}").alias("infinities"),
        )
        for i, c in enumerate(chosen)
    ], "column string, extreme long, max_abs double, nulls long, infinities long")


def null_inf_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULLs of every column and infinities of the numeric ones, one row per column."""
    chosen, numeric = list(columns or df.columns), set(_numeric_columns(df))
    row = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(chosen)],
        *[
            (F.count_if(_infinite(F.col(c))) if c in numeric else F.lit(0).cast("long")).alias(f"f{i}")
            for i, c in enumerate(chosen)
        ],
    )
    return _rows(row, [
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls"), F.col(f"f{i}").alias("infinities"))
        for i, c in enumerate(chosen)
    ], "column string, nulls long, infinities long")


def rest_anomalies(df: DataFrame, columns: Sequence[str] | None = None, limit: float = REST_LIMIT) -> DataFrame:
    """Impossible rest advantages: count beyond the limit and the largest, per ``*rest*advantage*`` column."""
    chosen = list(columns or [c for c in df.columns if "rest" in c.lower() and "advantage" in c.lower()])
    size = {c: F.abs(F.col(c).cast("double")) for c in chosen}
    row = df.agg(
        *[F.count_if(size[c] > limit).alias(f"x{i}") for i, c in enumerate(chosen)],
        *[F.max(size[c]).alias(f"m{i}") for i, c in enumerate(chosen)],
    ) if chosen else df.limit(0)
    return _rows(row, [
        F.struct(F.lit(c).alias("column"), F.col(f"x{i}").alias("anomalies"), F.col(f"m{i}").alias("max_abs"))
        for i, c in enumerate(chosen)
    ], "column string, anomalies long, max_abs double")


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Extra copies beyond the first per key (NULL keys are equal)."""
    return df.groupBy(*keys).agg(F.count("*").alias("__c")).agg(
        F.lit(",".join(keys)).alias("keys"), F.coalesce(F.sum(F.col("__c") - 1), F.lit(0)).alias("duplicates")
    )


def pair_consistency(df: DataFrame, home: str = "home_team", away: str = "away_team") -> DataFrame:
    """Games of a team against itself and games with a missing side."""
    h, a = F.col(home), F.col(away)
    return df.agg(
        F.count_if(h == a).alias("self_matchups"),
        F.count_if(h.isNull()).alias("missing_home"),
        F.count_if(a.isNull()).alias("missing_away"),
    )


def _in_one_scan(df: DataFrame, counts: Mapping[str, Column], tops: Mapping[str, Column], keys: Sequence[str]) -> DataFrame:
    """One row with all ``counts`` and ``tops`` of the frame and the extra copies of its keys (``duplicates``).

    Counters and maxima are taken per key, where rows of a key meet anyway, and then added up: one scan, one exchange by key.
    Without keys they are one global aggregate.
    """
    per_key = df.groupBy(*keys).agg(
        F.count("*").alias("__rows"), *[F.count_if(c).alias(n) for n, c in counts.items()], *[F.max(c).alias(n) for n, c in tops.items()]
    )
    return per_key.agg(
        F.coalesce(F.sum(F.col("__rows") - 1), F.lit(0)).alias("duplicates"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counts], *[F.max(n).alias(n) for n in tops]
    )


def run_quality_suite(
    df: DataFrame,
    features: DataFrame | None = None,
    home: str = "home_team",
    away: str = "away_team",
    game: str = "game_id",
) -> DataFrame:
    """All checks as finding rows ``(check, column, n, max_abs)``.

    Each frame is scanned once: every check is a counter or a maximum of one aggregate, duplicates included.
    """

    def finding(check: str, column: str, n: str, top: str | None = None) -> Column:
        return F.struct(
            F.lit(check).alias("check"), F.lit(column).alias("column"), F.col(n).cast("long").alias("n"),
            (F.col(top) if top else F.lit(None)).cast("double").alias("max_abs"),
        )

    def size(c: str) -> Column:
        return F.abs(F.col(c).cast("double"))

    lines = [c for c in _numeric_columns(df) if "line" in c.lower() or "spread" in c.lower()]
    h, a = F.col(home), F.col(away)
    counts = {"self": h == a, "no_home": h.isNull(), "no_away": a.isNull()}
    counts |= {f"x{i}": size(c) > SPREAD_LIMIT for i, c in enumerate(lines)} | {f"n{i}": F.col(c).isNull() for i, c in enumerate(lines)}
    counts |= {f"f{i}": _infinite(F.col(c)) for i, c in enumerate(lines)}
    rows = [r for i, c in enumerate(lines) for r in (finding("extreme_value", c, f"x{i}", f"m{i}"), finding("null_line", c, f"n{i}"), finding("infinite_line", c, f"f{i}"))]
    rows += [finding("self_matchup", f"{home},{away}", "self"), finding("missing_side", home, "no_home"), finding("missing_side", away, "no_away")]
    keys = [game] if game in df.columns else []
    rows += [finding("duplicate_key", game, "duplicates")] if keys else []
    found = _in_one_scan(df, counts, {f"m{i}": size(c) for i, c in enumerate(lines)}, keys).select(F.inline(F.array(*rows)))
    if features is None:
        return found

    columns, numeric = features.columns, set(_numeric_columns(features))
    rests = [c for c in columns if "rest" in c.lower() and "advantage" in c.lower()]
    counts = {f"n{i}": F.col(c).isNull() for i, c in enumerate(columns)} | {f"r{i}": size(c) > REST_LIMIT for i, c in enumerate(rests)}
    counts |= {f"f{i}": _infinite(F.col(c)) if c in numeric else F.lit(False) for i, c in enumerate(columns)}
    rows = [r for i, c in enumerate(columns) for r in (finding("null_feature", c, f"n{i}"), finding("infinite_feature", c, f"f{i}"))]
    rows += [finding("rest_anomaly", c, f"r{i}", f"m{i}") for i, c in enumerate(rests)]
    keys = [home, away] if {home, away} <= set(columns) else []
    rows += [finding("duplicate_pair", f"{home},{away}", "duplicates")] if keys else []
    if not rows:
        return found
    return found.unionByName(_in_one_scan(features, counts, {f"m{i}": size(c) for i, c in enumerate(rests)}, keys).select(F.inline(F.array(*rows))))


def source_diagnosis(completeness: DataFrame, features: Mapping[str, tuple[str, float]]) -> DataFrame:
    """Sources that are missing or invalid and the features that fall back to a default because of it.

    ``features`` maps ``category/provider`` to (feature, default); it is a literal, so this is a narrow
    projection of the completeness rows.
    """
    source = F.concat_ws("/", "category", "provider")
    feature = reduce(
        lambda acc, kv: acc.when(source == kv[0], F.lit(kv[1][0])), features.items(), F.when(F.lit(False), F.lit(""))
    )
    default = reduce(
        lambda acc, kv: acc.when(source == kv[0], F.lit(float(kv[1][1]))), features.items(), F.when(F.lit(False), F.lit(0.0))
    )
    return completeness.filter(~F.col("ok")).select(
        "season", "week", "category", "provider", "required", feature.alias("disabled_feature"), default.alias("default_value")
    )
