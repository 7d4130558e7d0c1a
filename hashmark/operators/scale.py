"""Building blocks that keep hot keys and global orders out of a single task.

* ``split_histories`` lets a trailing window run when one key holds a large share of all rows.
* ``running_total`` and ``global_position`` replace windows without (useful) partitions.
* ``exact_percentiles`` gives exact order statistics without collecting a group.

While a plan is built only two kinds of job run: ``exact_percentiles`` reads its brackets, and global orders are written as
tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashmark.session import written

CHUNK = "__chunk"
CARRIED = "__carried"
CHUNK_ROWS = 4_000_000
BAND_SLICES = 512


def join_back(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join per-key values back to rows; NULL keys match.  The keys of ``small`` are renamed first, so
    a frame derived from ``df`` can be joined to it."""
    renamed = small.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    condition = reduce(lambda acc, k: acc & F.col(k).eqNullSafe(F.col(f"__k_{k}")), keys[1:],
                       F.col(keys[0]).eqNullSafe(F.col(f"__k_{keys[0]}")))
    joined = df.join(renamed, condition, how)
    return joined if how in ("left_anti", "left_semi") else joined.drop(*[f"__k_{k}" for k in keys])


def split_histories(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    carry: int,
    coarse: Sequence[str],
    chunk_rows: int = CHUNK_ROWS,
    cut: Column | None = None,
    light: Sequence[str] = (),
) -> DataFrame:
    """Cut per-key histories into chunks so that trailing frames of up to ``carry`` rows stay exact.

    Adds ``__chunk`` and ``__carried``.  A window partitioned by ``keys + __chunk`` and ordered by
    ``order`` sees, in front of each chunk, the last ``carry`` rows that precede it; those copies have
    ``__carried = true`` and are filtered out after the window.

    With ``cut``, a number that never falls along ``order`` (a season, a year), each of its values is a
    chunk and nothing is counted.  Otherwise ``coarse``, a prefix of ``order`` (for example season, week,
    day), is counted per key and chunks of about ``chunk_rows`` rows are cut between its values.  Either
    way the chunk tails are limited to ``carry`` rows per chunk before they are shuffled.  Columns in ``light`` are not read
    for the copies and are NULL there.
    """
    keys, order, coarse = list(keys), list(order), list(coarse)
    if cut is not None:
        return _with_carried(df.withColumn(CHUNK, F.coalesce(cut.cast("long"), F.lit(-1).cast("long"))), keys, order, carry, light)

    periods = df.groupBy(*keys, *coarse).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy(*coarse).rowsBetween(Window.unboundedPreceding, -1)
    cuts = periods.select(
        *keys,
        *coarse,
        F.floor(F.coalesce(F.sum("__n").over(before), F.lit(0)) / F.lit(chunk_rows)).cast("long").alias(CHUNK),
    ).filter(F.col(CHUNK) > 0)
    tagged = join_back(df, cuts, keys + coarse).withColumn(CHUNK, F.coalesce(F.col(CHUNK), F.lit(0).cast("long")))
    return _with_carried(tagged, keys, order, carry, light)


def _with_carried(tagged: DataFrame, keys: list[str], order: list[str], carry: int, light: Sequence[str] = ()) -> DataFrame:
    """The rows, and copies of the last ``carry`` rows before each chunk."""
    newest_first = Window.partitionBy(*keys, CHUNK).orderBy(*[F.col(c).desc() for c in order])
    tails = tagged.drop(*light).withColumn("__r", F.row_number().over(newest_first)).filter(F.col("__r") <= carry).drop("__r")
    ahead = Window.partitionBy(*keys).orderBy(CHUNK, *order).rowsBetween(1, carry)
    carried = (
        tails.withColumn("__ahead", F.collect_set(CHUNK).over(ahead))
        .withColumn("__to", F.explode(F.array_remove("__ahead", F.col(CHUNK))))
        .withColumn(CHUNK, F.col("__to"))
        .drop("__to", "__ahead")
        .withColumn(CARRIED, F.lit(True))
    )
    return tagged.withColumn(CARRIED, F.lit(False)).unionByName(carried, allowMissingColumns=True)


def history_window(keys: Sequence[str], order: Sequence[str]) -> "Window":
    """Window over the output of ``split_histories``."""
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def drop_carried(df: DataFrame) -> DataFrame:
    """Remove the copies that ``split_histories`` added."""
    return df.filter(~F.col(CARRIED)).drop(CARRIED, CHUNK)


PART, AT = "__part", "__at"
#: The low bits of ``__at`` number the rows of a range.
AT_BITS = 33


def in_ranges(df: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """The rows as a table in ``order``: dealt by one range exchange, sorted in each range.

    Adds ``__part``, which never falls along ``order``, and ``__at``, which grows along it without gaps inside a range.  The
    bounds are sampled over the whole of ``order``, text columns included, so no period and no key is one task's.  ``df`` is
    read twice, for the sample and for the rows; whatever follows reads the table.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ordered.withColumn(AT, F.monotonically_increasing_id()), label).withColumn(PART, F.shiftright(AT, AT_BITS))


def running_total(df: DataFrame, keys: Sequence[str], coarse: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Cumulative sum per key in ``coarse + order``: sums of ranges first, then sums inside a range."""
    keys = list(keys)
    rows = in_ranges(df, [*keys, *coarse, *order], "totals")
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    # a range begins inside one key at most, so there are no more offsets than ranges
    offsets = (
        rows.groupBy(*keys, PART).agg(F.sum(value).alias("__s"))
        .select(*keys, PART, F.sum("__s").over(before).alias("__before")).filter(F.col("__before").isNotNull())
    )
    inside = Window.partitionBy(PART, *keys).orderBy(AT).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = F.lit(0)
    return (
        join_back(rows.withColumn(name, F.sum(value).over(inside)), F.broadcast(offsets), [*keys, PART])
        .withColumn(name, F.coalesce(F.col("__before"), zero) + F.coalesce(F.col(name), zero))
        .drop("__before", PART, AT)
    )


def global_position(
    df: DataFrame, coarse: Sequence[str], order: Sequence[str], name: str = "position", total: str = "total"
) -> DataFrame:
    """Zero-based position of every row in ``coarse + order``, and the row count, without a global sort.

    Rows are numbered where the range exchange puts them; only the counts of the ranges meet in one task.
    """
    rows = in_ranges(df, [*coarse, *order], "positions")
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = rows.groupBy(PART).agg(F.count("*").alias("__n")).select(
        PART, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(whole).alias(total)
    )
    return (
        join_back(rows, F.broadcast(offsets), [PART])
        .withColumn(name, F.col("__before") + F.col(AT).bitwiseAND(F.lit((1 << AT_BITS) - 1)))
        .drop("__before", PART, AT)
    )


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    percentages: Mapping[str, float],
    extra: Mapping[str, Column] | None = None,
    accuracy: int = 20_000,
    max_keys: int = 10_000,
    band_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Exact linear-interpolated percentiles per key, as columns named by ``percentages``, next to any
    further aggregates in ``extra``.

    Two passes.  The first computes ``extra`` and a mergeable sketch that brackets each wanted rank to a
    band of a few parts in ``accuracy``.  The second counts the rows below the band and the distinct
    values inside it; the exact value is read off their cumulative counts.  A group is never gathered:
    equal values are counted, not listed, and a band that may hold more than ``band_rows`` distinct values
    is summed up in slices.  A report has few keys; up to ``max_keys`` brackets travel to
    the data as a broadcast, beyond that the brackets are joined by key.
    """
    keys, extra = list(keys), dict(extra or {})
    group = keys or ["__all"]
    rows = df if keys else df.withColumn("__all", F.lit(1))
    v = F.col(value).cast("double")
    margin = 3.0 / accuracy
    bounds = [b for p in percentages.values() for b in (max(0.0, p - margin), min(1.0, p + margin))]
    first_pass = rows.groupBy(*group).agg(
        *[c.alias(n) for n, c in extra.items()],
        F.count(v).alias("__n"), F.percentile_approx(v, bounds, accuracy).alias("__b"),
        F.min(v).alias("__lo"), F.max(v).alias("__hi"),
    )
    local = first_pass.limit(max_keys + 1).collect()
    small = len(local) <= max_keys
    sliced = not small or max((r["__n"] for r in local), default=0) * 2 * margin > band_rows
    if small:
        first_pass = df.sparkSession.createDataFrame(local, first_pass.schema)

    bands = F.array(*[
        F.struct(
            F.lit(n).alias("__name"),
            (F.lit(p) * (F.col("__n") - 1)).alias("__rank"),
            # the outermost bands are open to the extremes, so rank 0 and n-1 are inside
            (F.col("__lo") if bounds[2 * i] == 0.0 else F.get("__b", F.lit(2 * i))).alias("__from"),
            (F.col("__hi") if bounds[2 * i + 1] == 1.0 else F.get("__b", F.lit(2 * i + 1))).alias("__to"),
        )
        for i, (n, p) in enumerate(percentages.items())
    ])
    wanted = first_pass.filter(F.col("__n") > 0).select(*group, F.inline(bands))
    narrow = rows.select(*group, v.alias("__v"))
    # rows below and above a band collapse to one row each per key, name and task before they move; only
    # their nearest value to the band can be an order statistic next to it
    x, below, inside, above = F.col("__v"), F.lit(-1), F.lit(0), F.lit(1)
    zone = F.when(x < F.col("__from"), below).when(x > F.col("__to"), above).when(x.isNotNull(), inside)
    share = F.try_divide(x - F.col("__from"), F.col("__to") - F.col("__from"))
    piece = F.coalesce(F.floor(share * BAND_SLICES), F.lit(0)).cast("int") if sliced else F.lit(0)
    zoned = join_back(narrow, F.broadcast(wanted) if small else wanted, group, "inner").select(
        *group, "__name", "__rank", zone.alias("__zone"), F.when(zone == inside, piece).alias("__slice"),
        F.when(zone == inside, x).alias("__in"), "__v",
    )
    counted = zoned.groupBy(*group, "__name", "__rank", "__zone", "__slice", "__in").agg(
        F.count("__v").alias("__c"), F.max("__v").alias("__max"), F.min("__v").alias("__min")
    ).filter(F.col("__c") > 0)
    return join_back(first_pass.select(*group, *extra), percentiles_from_counts(counted, group, list(percentages), sliced), group).select(
        *keys, *extra, *percentages
    )


def percentiles_from_counts(counted: DataFrame, group: Sequence[str], names: Sequence[str], sliced: bool) -> DataFrame:
    """Percentiles read off counted values, as columns ``names`` per ``group``.

    ``counted`` has for each ``group``, ``__name`` and ``__rank`` the values inside a band (``__zone`` 0, ``__slice``, ``__in``,
    ``__c`` rows) and one row each for what is below (-1) and above (1), with the largest and smallest value of each row.
    """
    if sliced:
        # totals of slices first, so that a long band is many tasks' work
        slices = [*group, "__name", "__zone", "__slice"]
        counted = written(counted, "counted")
        before = Window.partitionBy(*group, "__name").orderBy("__zone", "__slice").rowsBetween(Window.unboundedPreceding, -1)
        totals = counted.groupBy(*slices).agg(F.sum("__c").alias("__t"))
        totals = totals.select(*slices, F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__before"))
        inside = Window.partitionBy(*slices).orderBy("__in").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = join_back(counted, totals, slices).withColumn("__cum", F.col("__before") + F.sum("__c").over(inside)).drop("__before")
    else:
        so_far = (
            Window.partitionBy(*group, "__name").orderBy("__zone", "__in")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        ranked = counted.withColumn("__cum", F.sum("__c").over(so_far))
    ranked = ranked.withColumn("__value", F.when(F.col("__zone") < 0, F.col("__max")).otherwise(F.col("__min")))

    def at(position: Column) -> Column:
        return F.min(F.when(F.col("__cum") > position, F.struct("__zone", F.col("__in"), "__value", "__cum", "__c")))

    points = ranked.groupBy(*group, "__name", "__rank").agg(
        at(F.floor("__rank")).alias("__low"), at(F.ceil("__rank")).alias("__high")
    )
    low, high = F.col("__low"), F.col("__high")
    # below the band only its last row is known, above the band only its first
    known = ((low["__zone"] >= 0) | (F.floor("__rank") == low["__cum"] - 1)) & (
        (high["__zone"] <= 0) | (F.ceil("__rank") == high["__cum"] - high["__c"])
    )
    points = points.select(
        *group, "__name", "__rank",
        F.when(known, low["__value"]).otherwise(F.raise_error(F.lit("percentile outside its band")).cast("double")).alias("__a"),
        high["__value"].alias("__z"),
    )
    value_at = F.col("__a") + (F.col("__z") - F.col("__a")) * (F.col("__rank") - F.floor("__rank"))
    return points.groupBy(*group).agg(*[F.max(F.when(F.col("__name") == n, value_at)).alias(n) for n in names])
