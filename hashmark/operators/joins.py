"""Two-sided dimension joins, rating merges, alias normalisation and threshold joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashmark.functions.scoring import side_differences
from hashmark.operators.scale import join_back
from hashmark.operators.windows import FORM_SOURCES


def join_cardinality(dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys, repeated keys and the largest repetition: what a join on ``keys`` would multiply."""
    return dim.groupBy(*keys).agg(F.count("*").alias("__c")).agg(
        F.coalesce(F.sum("__c"), F.lit(0)).alias("row_count"),
        F.count("*").alias("distinct_keys"),
        F.count_if(F.col("__c") > 1).alias("repeated_keys"),
        F.max("__c").alias("largest"),
    )


def guard_unique(dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows, but the job fails if a key occurs twice: a join can never multiply facts silently.

    Rows with a NULL key can match nothing and are left out, however often they occur.
    With one row per key a maximum is the row's own value, so numeric dimensions stay in a hash
    aggregate; the check is a filter and cannot be pruned away.
    """
    values = [f for f in dim.schema.fields if f.name not in keys]
    folded = dim.dropna(subset=list(keys)).groupBy(*keys).agg(
        F.count("*").alias("__c"),
        *[(F.first if isinstance(f.dataType, T.MapType) else F.max)(F.col(f.name)).alias(f.name) for f in values],
    )
    complaint = F.raise_error(F.format_string("join key is not unique: %s rows", F.col("__c"))).cast("boolean")
    return folded.filter(F.when(F.col("__c") == 1, F.lit(True)).otherwise(complaint)).select(dim.columns)


def best_per_key(dim: DataFrame, keys: Sequence[str], weight: str, tie_break: Sequence[str]) -> DataFrame:
    """One row per key: the one with the largest weight (for example the passer with most plays)."""
    values = [c for c in dim.columns if c not in keys]
    top = F.max_by(F.struct(*values), F.struct(F.col(weight), *[F.col(t) for t in tie_break])).alias("__row")
    return dim.groupBy(*keys).agg(top).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in values])


def join_both_sides(
    games: DataFrame,
    ratings: DataFrame,
    key: str = "team",
    home: str = "home_team",
    away: str = "away_team",
    on: Sequence[str] = (),
    guard: bool = True,
) -> DataFrame:
    """Left join ratings to both sides; every rating column gets ``_home`` and ``_away`` copies.

    ``on`` lists further keys that both frames share, such as the season.  Ratings are guarded to be unique
    (``guard=False`` for a table whose key is unique by construction).  Whether they are broadcast is left to
    adaptive execution, which knows their bytes; its sort-merge join splits hot teams by itself.
    """
    guarded = guard_unique(ratings, [key, *on]) if guard else ratings
    values = [c for c in guarded.columns if c not in (key, *on)]
    out = games
    for column, suffix in ((home, "home"), (away, "away")):
        side = guarded.withColumnsRenamed({key: "__team", **{v: f"{v}_{suffix}" for v in values}})
        side = side.withColumnsRenamed({k: f"__{k}" for k in on})
        condition = F.col(column) == F.col("__team")
        for k in on:
            condition = condition & (F.col(k) == F.col(f"__{k}"))
        out = out.join(side, condition, "left").drop("__team", *[f"__{k}" for k in on])
    return out


def matchup_features(
    games: DataFrame, ratings: DataFrame, offense: str = "epa_off", defense: str = "epa_def", **kwargs
) -> DataFrame:
    """Each side's offence against the other's defence, if the ratings have both columns."""
    out = join_both_sides(games, ratings, **kwargs)
    if {offense, defense} <= set(ratings.columns):
        out = side_differences(out, {
            "home_off_vs_away_def": (f"{offense}_home", f"{defense}_away"),
            "away_off_vs_home_def": (f"{offense}_away", f"{defense}_home"),
        })
    return out


def join_form_both_sides(
    games: DataFrame, form: DataFrame, columns: Sequence[str] = tuple(FORM_SOURCES)
) -> DataFrame:
    """Join form to both sides on (team, season, week) and keep only the differences."""
    joined = join_both_sides(
        games, form.select("team", "season", "week", *columns), on=("season", "week"), guard=False,
    )
    diffs = side_differences(joined, {f"{c}_diff": (f"{c}_home", f"{c}_away") for c in columns})
    return diffs.drop(*[f"{c}_{s}" for c in columns for s in ("home", "away")])


def merge_ratings(
    base: DataFrame, others: Sequence[tuple[str, DataFrame | None]], key: str = "team"
) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Left join further rating tables onto the base; only clashing columns take the source's suffix.

    Returns the merged frame and the skipped sources with the reason: absent, or without the key.
    A source must have one row per key; reduce it with ``best_per_key`` first.
    """
    if base is None:
        raise ValueError("the base ratings are required")
    out, skipped = base, []
    for name, other in others:
        if other is None:
            skipped.append((name, "missing"))
            continue
        if key not in other.columns:
            skipped.append((name, "no key"))
            continue
        taken = set(out.columns)
        renamed = guard_unique(other, [key]).withColumnsRenamed(
            {c: f"{c}_{name}" for c in other.columns if c != key and c in taken}
        )
        # team tables are small by their file sizes, which is what Spark's own broadcast choice goes by
        out = out.join(renamed, key, "left")
    return out, skipped


def merge_audit(base: DataFrame, other: DataFrame, key: str = "team") -> DataFrame:
    """Keys of the right side that the base does not have, and would be lost in the merge."""
    right = other.select(key).filter(F.col(key).isNotNull()).distinct()
    return join_back(right, base.select(key), [key], "left_anti")


def attach_weekly_stats(team_games: DataFrame, stats: DataFrame, key: str = "team") -> DataFrame:
    """Left join period statistics to team-games on (season, week, team)."""
    renamed = guard_unique(stats.withColumnRenamed(key, "team"), ["season", "week", "team"])
    return team_games.join(renamed, ["season", "week", "team"], "left")


def attach_season_means(games: DataFrame, team_season: DataFrame, value: str = "epa_margin") -> DataFrame:
    """Season-level margin of both sides and its difference; games with a missing side are dropped."""
    joined = join_both_sides(games, team_season.select("team", "season", value), on=("season",))
    out = side_differences(joined, {f"{value}_diff": (f"{value}_home", f"{value}_away")})
    return out.dropna(subset=[f"{value}_diff"])


def at_thresholds(df: DataFrame, thresholds: Sequence[float], size: str = "abs_edge") -> DataFrame:
    """One copy of a row for every threshold its edge reaches.

    The thresholds are a literal array, so this is a narrow generator and not a join.
    """
    reached = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t <= F.col(size))
    return df.withColumn("threshold", F.explode(reached))


def registry_frame(spark, models: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Model registry as rows ``(model, term, weight)``; the intercept is the term ``intercept``."""
    rows = [(m, t, float(w)) for m, terms in models.items() for t, w in terms.items()]
    return spark.createDataFrame(rows, "model string, term string, weight double")


def score_models(df: DataFrame, registry: Mapping[str, Mapping[str, float]], models: Sequence[str] | None = None) -> DataFrame:
    """Score every row with every chosen model in one pass: output has ``model`` and ``pred``.

    The registry holds a handful of coefficient sets, so the scores are literal expressions in one
    generator: no unpivot, no join, no shuffle.  An unknown model is an error.
    """
    chosen = list(models or registry)
    unknown = [m for m in chosen if m not in registry]
    if unknown:
        raise KeyError(f"unknown models {unknown}")

    def score(terms: Mapping[str, float]) -> Column:
        total = F.lit(float(terms.get("intercept", 0.0)))
        for term, weight in terms.items():
            if term != "intercept":
                total = total + F.col(term) * F.lit(float(weight))
        return total

    scored = F.array(*[F.struct(F.lit(m).alias("model"), score(registry[m]).alias("pred")) for m in chosen])
    return df.select("*", F.inline(scored))


def read_registry(registry: DataFrame, max_rows: int = 10_000) -> dict[str, dict[str, float]]:
    """A registry table ``(model, term, weight)`` as a dict for ``score_models``.

    Coefficients are model parameters, not data; more than ``max_rows`` of them is an error.
    """
    rows = registry.select("model", "term", "weight").limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"registry has more than {max_rows} coefficients")
    models: dict[str, dict[str, float]] = {}
    for model, term, weight in rows:
        models.setdefault(model, {})[term] = weight
    return models


def normalize_entity(
    df: DataFrame, column: str, aliases: DataFrame, name: str = "team", on_unknown: str = "fail"
) -> DataFrame:
    """Replace spellings by codes: exact match first, then ignoring case, always trimmed.

    ``aliases`` has ``(alias, code)``.  Unknown spellings stop the job (``fail``), stay as NULL (``keep``) or
    lose the row (``drop``); ``unknown_entities`` counts them.
    """
    if on_unknown not in ("keep", "drop", "fail"):
        raise ValueError(f"on_unknown: {on_unknown}")
    small = aliases.groupBy(F.lower(F.trim("alias")).alias("__folded")).agg(
        F.map_from_entries(F.collect_set(F.struct(F.trim("alias"), F.col("code")))).alias("__exact"),
        F.min_by("code", "alias").alias("__code"),
    )
    spelled = df.withColumn("__spelling", F.trim(F.col(column)))
    joined = spelled.join(small, F.lower("__spelling") == F.col("__folded"), "left")
    code = F.coalesce(F.element_at("__exact", F.col("__spelling")), F.col("__code"))
    if on_unknown == "fail":
        known = F.col(column).isNull() | code.isNotNull()
        error = F.raise_error(F.concat(F.lit("unknown name: "), F.col(column)))
        code = F.when(known, code).otherwise(error.cast(T.StringType()))
    out = joined.withColumn(name, code).drop("__spelling", "__folded", "__exact", "__code")
    return out.filter(F.col(name).isNotNull()) if on_unknown == "drop" else out


def unknown_entities(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Distinct spellings without a code, with their row counts."""
    out = normalize_entity(df, column, aliases, name="__code", on_unknown="keep")
    return out.filter(F.col("__code").isNull() & F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("rows_seen"))


def apply_adjustments(
    df: DataFrame, adjustments: DataFrame, line: str | None = None, home: str | None = None, away: str | None = None
) -> DataFrame:
    """Manual adjustments of both sides: final line = line + (home adjustment - away adjustment).

    Accepts either line column and either naming of the sides.  A positive adjustment raises the line,
    as in the rule it follows.  Missing adjustments count 0 with an empty reason.
    """
    line = line or next((c for c in ("model_line", "final_line", "pred") if c in df.columns), None)
    if home is None or away is None:
        home, away = ("team_home", "team_away") if "team_home" in df.columns else ("home_team", "away_team")
    if line is None or not {home, away} <= set(df.columns):
        raise ValueError("a line column and both team columns are required")
    joined = join_both_sides(df, adjustments.select("team", "adjustment", "reason"), home=home, away=away)
    out = joined.withColumns({
        "subjective_home": F.coalesce("adjustment_home", F.lit(0.0)),
        "subjective_away": F.coalesce("adjustment_away", F.lit(0.0)),
        "subjective_reason_home": F.coalesce("reason_home", F.lit("")),
        "subjective_reason_away": F.coalesce("reason_away", F.lit("")),
    }).withColumn("final_line", F.col(line) + (F.col("subjective_home") - F.col("subjective_away")))
    return out.drop("adjustment_home", "adjustment_away", "reason_home", "reason_away")
