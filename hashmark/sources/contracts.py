"""What each source must provide.  Column names here are the canonical snake-case ones."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Contract:
    name: str
    required: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    optional: tuple[str, ...] = field(default=())


RATED_GAMES = Contract(
    "rated_games",
    required=("game_id", "season", "week", "home_team", "away_team", "rating_home", "rating_away", "home_line"),
    numeric=("season", "week", "rating_home", "rating_away", "home_line"),
)
POWER_RATINGS = Contract(
    "power_ratings", required=("team", "rating"), numeric=("rating",), optional=("qb_adj", "value", "wow", "ytd")
)
EPA_TIERS = Contract(
    "epa_tiers", required=("team", "epa_off", "epa_def"), numeric=("epa_off", "epa_def"), optional=("epa_margin",)
)
STRENGTH_OF_SCHEDULE = Contract("strength_of_schedule", required=("team",), optional=("opponent_rating", "sos_rank", "future_sos"))
OVERALL_RATINGS = Contract(
    "overall_ratings", required=("team", "off_rating", "def_rating", "overall"), numeric=("off_rating", "def_rating", "overall")
)
QB_EPA = Contract(
    "qb_epa", required=("team",), optional=("epa", "epa_per_play", "plays", "player")
)
WEEKLY_PROJECTIONS = Contract(
    "weekly_projections", optional=("team", "date", "matchup", "favorite_line", "win_prob")
)
TEAM_WEEK = Contract(
    "team_week",
    required=("season", "week", "team"),
    numeric=("season", "week"),
    optional=(
        "off_epa_per_play", "def_epa_per_play", "off_success_rate", "def_success_rate",
        "off_epa_total", "def_epa_total", "off_plays", "def_plays",
    ),
)
ALL = (
    RATED_GAMES, POWER_RATINGS, EPA_TIERS, STRENGTH_OF_SCHEDULE, OVERALL_RATINGS, QB_EPA, WEEKLY_PROJECTIONS, TEAM_WEEK,
)
