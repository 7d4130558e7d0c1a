"""Period statistics, rolling form and leak audits over the play binding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashmark.catalog.bindings import CORE_FLOATS, FULL_FLOATS, plays, sql, team_week
from hashmark.catalog.registry import query
from hashmark.operators import periods, reshape, windows
from hashmark.plans.datasets import rolling_team_form
from hashmark.session import scratch_path
from hashmark.sources import sinks

OFF = " ".join(f"off_{c}" for c in FULL_FLOATS)
DEF = " ".join(f"def_{c}" for c in FULL_FLOATS)
CORE = " ".join(f"{p}{c}" for p in ("off_", "def_") for c in CORE_FLOATS)
FORM = "offense_form_epa offense_form_success defense_form_epa defense_form_success"


@query("offense_by_period", sql("SELECT * FROM O", "O"), OFF)
def _(spark, sf_dir):
    return periods.offense_by_period(plays(spark, sf_dir))


@query("defense_by_period", sql("SELECT * FROM D", "D"), DEF)
def _(spark, sf_dir):
    return periods.defense_by_period(plays(spark, sf_dir))


@query("team_period_stats", sql("SELECT * FROM TW", "TW"), f"{OFF} {DEF}")
def _(spark, sf_dir):
    return periods.team_period_stats(plays(spark, sf_dir))


_CORE_COLUMNS = ", ".join(f"{p}{m}" for p in ("off_", "def_") for m in periods.CORE_METRICS)


@query("team_period_stats_core", sql(f"SELECT season, week, team, {_CORE_COLUMNS} FROM TW", "TW"), CORE)
def _(spark, sf_dir):
    return periods.team_period_stats(plays(spark, sf_dir), profile="core")


@query(
    "single_side_period_stats",
    sql(
        """SELECT season, week, team, off_plays AS plays, off_epa_per_play AS epa_per_play, off_epa_total AS epa_total,
        off_success_rate AS success_rate, CAST(explosive AS BIGINT) AS explosive_plays, off_pass_plays AS pass_plays, off_run_plays AS run_plays
        FROM O JOIN (SELECT season, week, posteam AS team, count(*) FILTER (epa > 0.5) AS explosive FROM P
          WHERE play_type IN ('pass', 'run') GROUP BY ALL) USING (season, week, team)""",
        "O",
    ),
    "epa_per_play epa_total success_rate",
)
def _(spark, sf_dir):
    return periods.single_side_period_stats(plays(spark, sf_dir))


@query(
    "both_sides_only",
    sql("SELECT season, week, team, off_plays, def_plays FROM O JOIN D USING (season, week, team)", "TW"),
)
def _(spark, sf_dir):
    p = plays(spark, sf_dir)
    return periods.both_sides_only(
        periods.offense_by_period(p, ["plays"]), periods.defense_by_period(p, ["plays"])
    )


@query(
    "game_side_summary",
    sql(
        """SELECT game_id, posteam, play_type, CASE WHEN grouping(play_type) = 1 THEN 'side' ELSE 'play_type' END AS level,
        count(*) AS plays, coalesce(sum(epa), 0.0) AS epa_sum, avg(epa) AS epa_mean, avg(success) AS success_rate,
        count(*) FILTER (epa > 0.5) AS explosive_plays
        FROM P WHERE play_type IN ('pass', 'run')
        GROUP BY GROUPING SETS ((game_id, posteam), (game_id, posteam, play_type))""",
        "P",
    ),
    "epa_sum epa_mean success_rate",
)
def _(spark, sf_dir):
    return periods.game_side_summary(plays(spark, sf_dir))


@query(
    "team_season_means",
    sql(
        """SELECT team, season, avg(off_epa_per_play) AS epa_off, avg(def_epa_per_play) AS epa_def,
        avg(off_epa_per_play) - avg(def_epa_per_play) AS epa_margin FROM TW GROUP BY team, season""",
        "TW",
    ),
    "epa_off epa_def epa_margin",
)
def _(spark, sf_dir):
    return periods.team_season_means(team_week(spark, sf_dir))


@query("entity_universe", sql("SELECT posteam AS team FROM P WHERE posteam IS NOT NULL UNION SELECT defteam FROM P WHERE defteam IS NOT NULL", "P"))
def _(spark, sf_dir):
    return periods.entity_universe(plays(spark, sf_dir))


@query(
    "coverage_summary",
    sql(
        """SELECT min(season) AS first_season, max(season) AS last_season, min(week) AS first_week, max(week) AS last_week,
        count(DISTINCT team) AS entities, count(*) AS row_count FROM TW""",
        "TW",
    ),
)
def _(spark, sf_dir):
    return periods.coverage_summary(team_week(spark, sf_dir))


@query("offense_form", sql("SELECT team, season, week, offense_form_epa, offense_form_success FROM FORM", "FORM"), "offense_form_epa offense_form_success")
def _(spark, sf_dir):
    return windows.offense_form(team_week(spark, sf_dir))


@query("defense_form", sql("SELECT team, season, week, defense_form_epa, defense_form_success FROM FORM", "FORM"), "defense_form_epa defense_form_success")
def _(spark, sf_dir):
    return windows.defense_form(team_week(spark, sf_dir))


@query("team_form", sql("SELECT * FROM FORM", "FORM"), FORM)
def team_form_query(spark, sf_dir) -> DataFrame:
    return rolling_team_form(plays(spark, sf_dir))


def _rolling_sql(n: int) -> str:
    w = f"OVER (PARTITION BY team ORDER BY season, week ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    off, dfn = f"avg(off_epa_per_play) {w}", f"avg(def_epa_per_play) {w}"
    return f"{off} AS epa_off_L{n}, {dfn} AS epa_def_L{n}, {off} - {dfn} AS epa_margin_L{n}"


@query(
    "rolling_multi",
    sql(f"SELECT team, season, week, {', '.join(_rolling_sql(n) for n in (3, 5, 10))} FROM TW", "TW"),
    " ".join(f"{c}_L{n}" for n in (3, 5, 10) for c in ("epa_off", "epa_def", "epa_margin")),
)
def _(spark, sf_dir):
    rolled = windows.rolling_multi(
        team_week(spark, sf_dir).select("team", "season", "week", "off_epa_per_play", "def_epa_per_play"),
        {"epa_off": "off_epa_per_play", "epa_def": "def_epa_per_play"},
        margin=("epa_margin", "epa_off", "epa_def"),
        coarse=["season"],
    )
    return rolled.drop("off_epa_per_play", "def_epa_per_play")


@query(
    "audit_leakage",
    sql(
        """SELECT 'offense_form_epa' AS feature, count(*) AS rows_checked, CAST(0 AS BIGINT) AS rows_leaking FROM TW
        UNION ALL SELECT 'leaky', count(*), count(*) FILTER (NOT coalesce(abs(honest - leaky) <= 1e-9, honest IS NULL AND leaky IS NULL)) FROM (
          SELECT avg(off_epa_per_play) OVER (PARTITION BY team ORDER BY season, week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS honest,
            avg(off_epa_per_play) OVER (PARTITION BY team ORDER BY season, week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS leaky FROM TW)""",
        "TW",
    ),
)
def _(spark, sf_dir):
    """A clean feature has no leaking row; one that sees the current period is caught."""
    from pyspark.sql import Window

    form = windows.offense_form(team_week(spark, sf_dir), keep=["off_epa_per_play"])
    seen = Window.partitionBy("team").orderBy("season", "week").rowsBetween(-3, 0)
    form = form.withColumn("leaky", F.avg("off_epa_per_play").over(seen))
    return windows.audit_leakage(form, "offense_form_epa", "off_epa_per_play", 4).unionByName(
        windows.audit_leakage(form, "leaky", "off_epa_per_play", 4)
    )


@query(
    "leakage_alarm",
    sql(
        """SELECT feature, r * r AS r_squared, coalesce(r * r > 0.95, false) AS alarm FROM (
        SELECT unnest(['off_success_rate', 'def_success_rate', 'copy']) AS feature,
          unnest([corr(off_success_rate, off_epa_per_play), corr(def_success_rate, off_epa_per_play), corr(off_epa_per_play * 2, off_epa_per_play)]) AS r FROM TW)""",
        "TW",
    ),
    "r_squared",
)
def _(spark, sf_dir):
    tw = team_week(spark, sf_dir).withColumn("copy", F.col("off_epa_per_play") * 2)
    return windows.leakage_alarm(tw, "off_epa_per_play", ["off_success_rate", "def_success_rate", "copy"])


@query(
    "upsert_period",
    sql(
        """SELECT season, week, team, off_plays, off_epa_per_play FROM TW WHERE season <> 1998
        UNION ALL SELECT season, week, team, off_plays + 1000, off_epa_per_play + 1 FROM TW WHERE season = 1998""",
        "TW",
    ),
    "off_epa_per_play",
)
def _(spark, sf_dir):
    """A restated season replaces the old one; all other periods stay."""
    tw = team_week(spark, sf_dir).select("season", "week", "team", "off_plays", "off_epa_per_play")
    new = tw.filter(F.col("season") == 1998).withColumns(
        {"off_plays": F.col("off_plays") + 1000, "off_epa_per_play": F.col("off_epa_per_play") + 1}
    )
    return reshape.upsert_period(tw, new, ["season", "week", "team"])


@query(
    "upsert_partitions",
    sql(
        """SELECT season, week, team, off_plays, off_epa_per_play FROM TW WHERE NOT (season IN (1996, 1998) AND week < 7)
        UNION ALL SELECT season, week, team, off_plays + 1000, off_epa_per_play + 1 FROM TW WHERE season IN (1996, 1998) AND week < 7""",
        "TW",
    ),
    "off_epa_per_play",
)
def _(spark, sf_dir):
    """Half of two restated seasons is merged into the written table; the partitions of all others are left as they are."""
    path = scratch_path(spark, "team-week")
    tw = team_week(spark, sf_dir).select("season", "week", "team", "off_plays", "off_epa_per_play")
    sinks.write_team_week(tw, path)
    new = tw.filter(F.col("season").isin(1996, 1998) & (F.col("week") < 7)).withColumns(
        {"off_plays": F.col("off_plays") + 1000, "off_epa_per_play": F.col("off_epa_per_play") + 1}
    )
    sinks.upsert_partitions(new, path, ["season", "week", "team"])
    return spark.read.schema(tw.schema).parquet(path)


@query(
    "dedup_keep",
    sql(
        """SELECT season, posteam, first_game, last_game FROM (
        SELECT season, posteam, min(game_id * 10 + down) AS first_game, max(game_id * 10 + down) AS last_game FROM P
        GROUP BY season, posteam)""",
        "P",
    ),
)
def _(spark, sf_dir):
    p = plays(spark, sf_dir).select("season", "posteam", (F.col("game_id") * 10 + F.col("down")).alias("game"))
    first = reshape.dedup_keep(p, ["season", "posteam"], ["game"], "first").withColumnRenamed("game", "first_game")
    last = reshape.dedup_keep(p, ["season", "posteam"], ["game"], "last").withColumnRenamed("game", "last_game")
    return first.join(last, ["season", "posteam"])
