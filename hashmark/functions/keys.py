"""Game keys, matchup strings and quoted lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed formats: key YYYY_WW_AWAY_HOME, matchup "A at B" / "A vs B", line "NE -10.5" / "WSH PK".
GAME_KEY = r"(\d{4})_(\d+)_(\w+)_(\w+)"
MATCHUP_WORDS = " at | vs "
SIGNED_NUMBER = r"([-+]?\d+\.?\d*)"
LEADING_CODE = r"^\s*([A-Za-z]+)"
PICK = r"(?i)\bPK\b|pick"


def _group(col: Column, pattern: str, index: int) -> Column:
    return F.nullif(F.regexp_extract(col, pattern, index), F.lit(""))


def parse_game_key(df: DataFrame, key: str = "game_id") -> DataFrame:
    """Add season, week, away_team and home_team; all NULL when the key does not match."""
    c = F.col(key)
    return df.withColumns(
        {
            "season": _group(c, GAME_KEY, 1).cast("int"),
            "week": _group(c, GAME_KEY, 2).cast("int"),
            "away_team": _group(c, GAME_KEY, 3),
            "home_team": _group(c, GAME_KEY, 4),
        }
    )


def format_game_key(season: str = "season", week: str = "week", away: str = "away_team", home: str = "home_team") -> Column:
    """``YYYY_WW_AWAY_HOME`` with a two-digit week; NULL when any part is missing."""
    parts = [F.col(season), F.col(week), F.col(away), F.col(home)]
    present = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull() & parts[3].isNotNull()
    return F.when(present, F.format_string("%d_%02d_%s_%s", *parts))


def parse_matchup(df: DataFrame, matchup: str = "matchup", away: str = "away_team", home: str = "home_team") -> DataFrame:
    """Split a matchup string; ``vs`` marks a neutral site.  Anything else gives NULL teams."""
    parts = F.split(F.col(matchup), MATCHUP_WORDS)
    paired = F.size(parts) == 2
    return df.withColumns(
        {
            away: F.when(paired, F.trim(F.get(parts, F.lit(0)))),
            home: F.when(paired, F.trim(F.get(parts, F.lit(1)))),
            "is_neutral": F.when(paired, F.contains(F.col(matchup), F.lit(" vs "))),
        }
    )


def parse_quoted_line(
    df: DataFrame,
    quoted: str = "favorite_line",
    home_code: str | None = None,
    away_code: str | None = None,
    pick_as_zero: bool = False,
) -> DataFrame:
    """First signed number of a quoted line, the favourite's code and the home-perspective line.

    ``quoted_line`` keeps the raw number next to the favourite; ``home_line`` flips its sign when the
    away side is the favourite.  A pick'em has no number: NULL, or 0 on request.
    """
    c = F.col(quoted)
    number = F.nullif(F.regexp_extract(c, SIGNED_NUMBER, 1), F.lit("")).try_cast("double")
    if pick_as_zero:
        number = F.coalesce(number, F.when(F.regexp_like(c, F.lit(PICK)), F.lit(0.0)))
    out = df.withColumns({"favorite": _group(c, LEADING_CODE, 1), "quoted_line": number})
    if home_code is None or away_code is None:
        return out
    return out.withColumn(
        "home_line",
        F.when(F.col("favorite") == F.col(home_code), F.col("quoted_line"))
        .when(F.col("favorite") == F.col(away_code), F.negative(F.col("quoted_line"))),
    )


def first_listed(col: Column, separator: str = ",") -> Column:
    """First entry of a comma list, trimmed: ``"cle, cin"`` gives ``cle``."""
    return F.trim(F.get(F.split(col, separator), F.lit(0)))
