"""A join that no single key can hold up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds at least one in so many rows: there are never more hot keys than this.
SHARES = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """``rows`` left joined with ``groups`` (unique by ``keys``, which are not NULL; ``size``: how many rows have the key).

    Groups that hold a thousandth of all rows each, a thousand at most, are broadcast; rows that have met one go on with a
    salted key, so the shuffle for the other groups deals them evenly.  ``groups`` is read more than once: pass a written table.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) * SHARES >= F.lit(total)
    values = [c for c in groups.columns if c not in keys]
    most = groups.filter(hot).select(*keys, *[F.col(c).alias(f"__hot_{c}") for c in values], F.lit(True).alias("__hot"))
    rest = groups.filter(~hot).withColumn("__salt", F.lit(0))
    salt = F.when(F.col("__hot"), 1 + F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(1 << 20)).cast("int")).otherwise(0)
    met = rows.join(F.broadcast(most), list(keys), "left").withColumn("__salt", salt)
    joined = met.join(rest, [*keys, "__salt"], "left")
    return joined.select(*rows.columns, *[F.when(F.col("__hot"), F.col(f"__hot_{c}")).otherwise(F.col(c)).alias(c) for c in values])
