"""Missing values and report rounding.

Spark compares NaN as larger than every number and lets it poison sums, so scans turn NaN into NULL
once and everything above works with NULL only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATING = (T.DoubleType, T.FloatType)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, FLOATING)}
    if not floats:
        return df
    return df.select(
        *[
            F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def require_complete(df: DataFrame, columns: Sequence[str], nan: bool = False) -> DataFrame:
    """Keep rows in which every listed column is present.

    Plain IS NOT NULL terms, which (unlike ``dropna``) reach the Parquet reader; scans have already
    turned NaN into NULL.  For stored columns that may still hold it, ``nan`` drops NaN as well.
    """
    terms = [F.col(c).isNotNull() for c in columns]
    if nan:
        terms += [~F.isnan(c) for c in columns if isinstance(df.schema[c].dataType, FLOATING)]
    return df.filter(reduce(lambda a, b: a & b, terms))


def fill_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Fill NULLs column by column; the value takes the column's own type."""
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in defaults.items()}
    )


def missing_any(columns: Sequence[str]) -> Column:
    """True when at least one of the columns is NULL."""
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def round_for_report(df: DataFrame, columns: Sequence[str], digits: int) -> DataFrame:
    """Half-even rounding of report columns."""
    return df.withColumns({c: F.bround(F.col(c), digits) for c in columns})


def first_type_or(df: DataFrame, column: str, dtype: str) -> Column:
    """The column if the frame has it, otherwise a typed NULL under the same name."""
    if column in df.columns:
        return F.col(column)
    return F.lit(None).cast(dtype).alias(column)
