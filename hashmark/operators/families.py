"""Feature families chosen by column name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The name patterns of the correction model's features.
PATTERNS = ("_L3", "_L5", "_L10", "rest_", "matchup_", "qb_", "coach_")


def family_columns(df: DataFrame, patterns: Sequence[str] = PATTERNS) -> list[str]:
    """Columns whose name contains one of the patterns, in frame order."""
    return [c for c in df.columns if any(p in c for p in patterns)]


def columns_by_family(df: DataFrame, patterns: Sequence[str] = PATTERNS, keep: Sequence[str] = ()) -> DataFrame:
    """The matching columns, after the kept ones; pruning reaches the scan."""
    return df.select(*keep, *[c for c in family_columns(df, patterns) if c not in keep])


def family_report(df: DataFrame, families: Mapping[str, Sequence[str]]) -> DataFrame:
    """``(family, column, type, filled)`` for every column that falls into a family; ``filled`` counts its values, in one scan."""
    found = [(name, c, df.schema[c].dataType.simpleString()) for name, ps in families.items() for c in family_columns(df, ps)]
    if not found:
        return df.sparkSession.createDataFrame([], "family string, column string, type string, filled long")
    at = {c: f"f{i}" for i, c in enumerate(dict.fromkeys(c for _, c, _ in found))}
    counted = df.agg(*[F.count(F.col(f"`{c}`")).alias(n) for c, n in at.items()])
    rows = [
        F.struct(F.lit(name).alias("family"), F.lit(c).alias("column"), F.lit(kind).alias("type"), F.col(at[c]).alias("filled")) for name, c, kind in found
    ]
    return counted.select(F.inline(F.array(*rows)))
