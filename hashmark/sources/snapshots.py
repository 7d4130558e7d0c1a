"""Provider snapshots: a folder of CSV files whose names carry category, provider, season and week.

All files of a category are read by one scan, as lines.  Columns are found by header name inside each
file, so files with any number of columns, duplicate header names, a byte-order mark or lines above the
header can sit side by side; nothing is inferred and no file is opened by the driver.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashmark.functions.keys import first_listed
from hashmark.operators.joins import best_per_key, merge_ratings, normalize_entity
from hashmark.operators.scale import join_back
from hashmark.session import checkpointed

PERIOD_KEYS = ("category", "provider", "season", "week")
# Fixed formats: category first, or the three older provider-first forms.  ``.csv`` may also name a folder.
CATEGORY_FIRST = r"([^/]+)_(\d{4})_week_(\d+)\.csv"
PROVIDER_FIRST_TAIL = r"_(\d{4})_week_(\d+)\.csv"


@dataclass(frozen=True)
class Layout:
    """Where a category's canonical columns are found: alternative header names in order of preference."""

    category: str
    key_headers: tuple[str, ...]
    numbers: Mapping[str, tuple[str, ...]]
    texts: Mapping[str, tuple[str, ...]] = None


POWER_RATINGS = Layout(
    "power_ratings", ("team",),
    numbers={
        "rating": ("nfelo", "rating"), "qb_adj": ("qb adj",), "value": ("value",), "wow": ("wow",), "ytd": ("ytd",),
        "off_rating": ("off.", "offense"), "def_rating": ("def.", "defense"), "overall": ("ovr.", "overall"),
    },
)
EPA_TIERS = Layout(
    "epa_tiers", ("team",),
    numbers={"epa_off": ("epa_off", "epa/play", "off_epa_per_play"), "epa_def": ("epa_def", "epa/play against", "def_epa_per_play")},
)
STRENGTH_OF_SCHEDULE = Layout(
    "strength_of_schedule", ("team",),
    numbers={
        "original_rating": ("original rating",), "current_rating": ("current rating",), "win_total": ("win total",),
        "opponent_rating": ("avg. opp. rating", "sos_value"), "sos_rank": ("rank", "sos_rank"), "future_sos": ("future_sos",),
        "past_opponent_rating": ("avg. opp. rating.1",), "past_rank": ("rank.1",),
        "future_opponent_rating": ("avg. opp. rating.2",), "future_rank": ("rank.2",),
    },
)
QB_EPA = Layout(
    "qb_epa", ("tms", "team"),
    numbers={"epa": ("epa",), "plays": ("plays",), "epa_per_play": ("val/pl", "epa/play"), "age": ("age",)},
    texts={"player": ("player", "qb")},
)
WEEKLY_PROJECTIONS = Layout(
    "weekly_projections_ppg", ("team",),
    numbers={"win_prob": ("win prob.",), "proj_ppg": ("proj_ppg",), "proj_pa": ("proj_pa",), "proj_margin": ("proj_margin",)},
    texts={"date": ("date",), "matchup": ("matchup",), "favorite_line": ("favorite",)},
)
LAYOUTS = {l.category: l for l in (POWER_RATINGS, EPA_TIERS, STRENGTH_OF_SCHEDULE, QB_EPA, WEEKLY_PROJECTIONS)}


def _folded(col: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(col, "^﻿", "")))


def _forms(category: str) -> list[str]:
    """Path patterns of a category in order of preference; groups are provider, season and week."""
    short = category.replace("_projections_", "_proj_")
    return [
        rf"/{category}_{CATEGORY_FIRST}",
        rf"/([^/]+)_{category}{PROVIDER_FIRST_TAIL}",
        rf"/([^/]+)_{category}_off_def{PROVIDER_FIRST_TAIL}",
        rf"/([^/]+)_{short}{PROVIDER_FIRST_TAIL}",
    ]


def _listing(spark: SparkSession, pattern: str) -> list[str]:
    try:
        return list(spark.read.option("recursiveFileLookup", True).text(pattern).inputFiles())
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return []


def resolve_files(
    spark: SparkSession, folder: str, category: str, provider: str | None = None, season: int | None = None, week: int | None = None
) -> dict[str, tuple[str, int, int, bool]]:
    """Files to read, with their (provider, season, week, legacy), from Spark's listing of the folder.

    Provider, season and week, where given, are part of the pattern that is listed.  For each provider and
    period the best naming form present is used and the others are left out, so superseded files and other
    weeks are never opened.  Files that name the category but fit no form are reported by a warning.
    """
    short = category.replace("_projections_", "_proj_")
    period = f"*_{'*' if season is None else season}_week_{'*' if week is None else week}.csv*"
    listed = _listing(spark, f"{folder.rstrip('/')}/{{*{category}{period},*{short}{period}}}")
    found: dict[tuple[str, int, int], dict[int, list[str]]] = {}
    strange = []
    for path in listed:
        for preference, form in enumerate(_forms(category)):
            match = re.search(form, path)
            if match:
                own = (match[1], int(match[2]), int(match[3]))
                found.setdefault(own, {}).setdefault(preference, []).append(path)
                break
        else:
            strange.append(path)
    if strange:
        warnings.warn(f"{len(strange)} files fit no form of {category}: {strange[:5]}", stacklevel=2)
    wanted = (provider, season, week)
    return {
        path: (*own, min(forms) > 0)
        for own, forms in found.items()
        if all(w is None or w == p for w, p in zip(wanted, own))
        for path in forms[min(forms)]
    }


def unmatched_files(spark: SparkSession, folder: str) -> list[str]:
    """CSV files of the folder that fit no form of any category."""
    forms = [form for category in LAYOUTS for form in _forms(category)]
    return sorted(p for p in _listing(spark, f"{folder.rstrip('/')}/*.csv*") if not any(re.search(f, p) for f in forms))


def raw_cells(spark: SparkSession, category: str, files: Mapping[str, tuple[str, int, int, bool]]) -> DataFrame:
    """The lines of the resolved files as ``(__path, __at, cells, category, provider, season, week, legacy)``.

    A line is cut at commas outside quotes, into as many cells as it has; empty cells are NULL.  ``__at``
    orders the lines of a file.
    """
    outside_quotes = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'

    def plain(value: Column) -> Column:
        bare = F.when(value.rlike(r'^\s*".*"\s*$'), F.replace(F.regexp_extract(value, r'^\s*"(.*)"\s*$', 1), F.lit('""'), F.lit('"')))
        return F.nullif(F.coalesce(bare, value), F.lit(""))

    read = spark.read.text(list(files)).filter(F.trim("value") != "")
    path = F.col("__path")

    def pick(group: int) -> Column:
        return F.coalesce(*[F.nullif(F.regexp_extract(path, form, group), F.lit("")) for form in _forms(category)])

    return read.select(
        F.col("_metadata.file_path").alias("__path"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("__at"),
        F.transform(F.split("value", outside_quotes, -1), plain).alias("cells"),
    ).select(
        "__path", "__at", "cells", F.lit(category).alias("category"), pick(1).alias("provider"), pick(2).cast("int").alias("season"),
        pick(3).cast("int").alias("week"), (~F.regexp_like(path, F.lit(_forms(category)[0]))).alias("legacy"),
    )


def drop_preamble(cells: DataFrame, key_headers: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Split raw rows into header rows and data rows, leaving out whatever stands above a header.

    The header is the first row of a file that has one of ``key_headers`` as a cell; every row below it that
    has any cell and is no further header is a data row.
    """
    folded = F.transform("cells", _folded)
    is_header = F.coalesce(F.arrays_overlap(folded, F.array(*[F.lit(h) for h in key_headers])), F.lit(False))
    # repeated names are told apart by a number, from the second on
    named = F.transform(F.col("header"), lambda h, i: _numbered(h, i))
    headers = (
        cells.filter(is_header).groupBy("__path")
        .agg(F.min_by(F.transform("cells", lambda c: F.coalesce(_folded(c), F.lit(""))), "__at").alias("header"), F.min("__at").alias("__top"))
        .withColumn("header", named)
    )
    below = (F.col("__at") > F.col("__top")) & F.exists("cells", lambda c: c.isNotNull())
    rows = join_back(cells.filter(~is_header), headers, ["__path"], "inner").filter(below)
    return headers.drop("__top"), rows.drop("__at", "__top")


def _numbered(name: Column, at: Column) -> Column:
    before = F.size(F.filter(F.slice(F.col("header"), F.lit(1), at), lambda x: x == name))
    return F.when((before == 0) | (name == ""), name).otherwise(F.concat(name, F.lit("."), before.cast("string")))


def all_cells() -> Column:
    """Every cell of a row by its header: lower case, repeated names numbered, cells without a header by position."""
    names = F.transform(
        F.sequence(F.lit(1), F.size("cells")),
        lambda i: F.coalesce(F.nullif(F.get("header", i - 1), F.lit("")), F.concat(F.lit("column_"), i.cast("string"))),
    )
    entries = F.filter(F.arrays_zip(names.alias("name"), F.col("cells").alias("cell")), lambda x: x["cell"].isNotNull())
    return F.when(F.size("cells") > 0, F.map_from_entries(entries))


def cell(*names: str) -> Column:
    """The cell under the first header that the file has, from left to right for repeated names."""
    at = [F.nullif(F.array_position("header", F.lit(n)), F.lit(0).cast("long")) for n in names]
    return F.get("cells", (F.coalesce(*at) - 1).cast("int"))


def scan_provider_snapshots(
    spark: SparkSession, folder: str, category: str, aliases: DataFrame | None = None,
    provider: str | None = None, season: int | None = None, week: int | None = None, cells_as: str | None = None,
) -> DataFrame | None:
    """One row per (provider, season, week, team or line of the file) with the category's columns.

    Where a category-first and an older file both exist for a period, the category-first one is used
    and ``legacy`` is false.  Teams are normalised when aliases are given (unknown ones are dropped).
    With ``cells_as`` a map of that name holds all cells of the row, also those that the layout does not name.
    ``None`` if there is no file.
    """
    files = resolve_files(spark, folder, category, provider, season, week)
    if not files:
        return None
    layout = LAYOUTS[category]
    cells = raw_cells(spark, category, files)
    _, rows = drop_preamble(cells, (*layout.key_headers, *_text_headers(layout)))
    out = rows.select(
        *PERIOD_KEYS,
        "legacy",
        first_listed(cell(*layout.key_headers)).alias("team"),
        *[F.trim(cell(*names)).alias(c) for c, names in (layout.texts or {}).items()],
        *[cell(*names).try_cast("double").alias(c) for c, names in layout.numbers.items()],
        *([all_cells().alias(cells_as)] if cells_as else []),
    )
    if category == "epa_tiers":
        out = out.withColumn("epa_margin", F.col("epa_off") - F.col("epa_def"))
    by_team = aliases is not None and category != WEEKLY_PROJECTIONS.category
    return normalize_entity(out, "team", aliases, "team", "drop") if by_team else out


def _text_headers(layout: Layout) -> tuple[str, ...]:
    return tuple(h for names in (layout.texts or {}).values() for h in names)


def power_ratings(spark: SparkSession, folder: str, aliases: DataFrame | None = None) -> DataFrame:
    return scan_provider_snapshots(spark, folder, "power_ratings", aliases)


def epa_tiers(spark: SparkSession, folder: str, aliases: DataFrame | None = None) -> DataFrame:
    return scan_provider_snapshots(spark, folder, "epa_tiers", aliases)


def strength_of_schedule(spark: SparkSession, folder: str, aliases: DataFrame | None = None) -> DataFrame:
    return scan_provider_snapshots(spark, folder, "strength_of_schedule", aliases)


def qb_epa(spark: SparkSession, folder: str, aliases: DataFrame | None = None) -> DataFrame:
    return scan_provider_snapshots(spark, folder, "qb_epa", aliases)


def weekly_projections(spark: SparkSession, folder: str, aliases: DataFrame | None = None) -> DataFrame:
    return scan_provider_snapshots(spark, folder, "weekly_projections_ppg", aliases)


def load_sources(
    spark: SparkSession, folder: str, season: int, week: int, sources: Sequence[tuple[str, str]], aliases: DataFrame | None = None
) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Read the listed (category, provider) sources of one week and merge them on team.

    The first source is the base and must exist.  Further ones are optional: an absent source or one
    without teams is skipped and reported.  Passers are reduced to the busiest one per team first.
    """
    frames: list[tuple[str, DataFrame | None]] = []
    for category, provider in sources:
        frame = scan_provider_snapshots(spark, folder, category, aliases, provider, season, week)
        if frame is not None:
            # one provider's week: parsed once, then merged from the checkpoint
            frame = checkpointed(frame.filter(F.col("team").isNotNull()).drop(*PERIOD_KEYS, "legacy"))
            if frame.isEmpty():
                frame = None
            elif category == "qb_epa":
                frame = best_per_key(frame, ["team"], "plays", ["player"])
        frames.append((f"{category}_{provider}", frame))
    (base_name, base), *others = frames
    if base is None:
        raise ValueError(f"the base source {base_name} is missing")
    return merge_ratings(base, others)


def source_completeness(
    snapshots: DataFrame, expected: Sequence[tuple[str, str, bool]], valid: Column | None = None
) -> DataFrame:
    """Per (season, week) and expected source: rows, valid rows and verdict, and whether the week is complete.

    ``expected`` lists (category, provider, required).  It is a literal array exploded onto the weeks that
    occur; the week is complete when every required source has valid rows.
    """
    ok_row = valid if valid is not None else F.lit(True)
    counts = snapshots.groupBy(*PERIOD_KEYS).agg(
        F.count("*").alias("row_count"), F.count_if(F.coalesce(ok_row, F.lit(False))).alias("valid_rows")
    )
    wanted = F.array(*[
        F.struct(F.lit(c).alias("category"), F.lit(p).alias("provider"), F.lit(r).alias("required")) for c, p, r in expected
    ])
    grid = counts.select("season", "week").distinct().select("season", "week", F.inline(wanted))
    checked = join_back(grid, counts, list(PERIOD_KEYS)).select(
        "season", "week", "category", "provider", "required",
        F.coalesce("row_count", F.lit(0)).alias("row_count"), F.coalesce("valid_rows", F.lit(0)).alias("valid_rows"),
    ).withColumn("ok", F.col("valid_rows") > 0)
    weeks = checked.groupBy("season", "week").agg(F.bool_and(F.col("ok") | ~F.col("required")).alias("week_complete"))
    return join_back(checked, weeks, ["season", "week"])
