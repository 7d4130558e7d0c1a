"""Registration of queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
HALVES_ASIDE = 0.00123
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None, floats: str = "", digits: int = 6):
    """Register a query.  ``floats`` are rounded to ``digits`` on both sides, because the order in which a
    distributed sum adds up is not fixed.

    Prices have two decimals, so means land on exact halves of the last digit, where the last bit would
    decide; a shift of a thousandth of that digit moves the halves out of the way.  Adding 0.0 turns a
    negative zero into zero.
    """
    rounded = floats.split()
    shift = HALVES_ASIDE * 10.0**-digits

    def register(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(spark, sf_dir)
            return out.withColumns({c: F.bround(F.col(c) + F.lit(shift), digits) + F.lit(0.0) for c in rounded}) if rounded else out

        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = run
        if sql is not None:
            replace = ", ".join(f"round_even({c} + {shift!r}::double, {digits}) + 0.0::double AS {c}" for c in rounded)
            ORACLES[name] = f"SELECT * REPLACE ({replace}) FROM ({sql})" if rounded else sql
        return fn

    return register
