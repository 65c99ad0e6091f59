"""Row-level predicates and projections over participant rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import default_team, strip_ws

# Participant ids of the two team rows of a game.
TEAM_ROW_IDS = ("100", "200")
SIDES = ("Blue", "Red")


def is_team_row():
    return F.col("participantid").isin(*TEAM_ROW_IDS)


def player_rows(rows: DataFrame) -> DataFrame:
    """Keep the player rows."""
    return rows.where(~is_team_row())


def team_rows(rows: DataFrame) -> DataFrame:
    """Keep the two team rows of each game."""
    return rows.where(is_team_row())


def blank_to_null(rows: DataFrame, *cols: str, tokens=("",)) -> DataFrame:
    """NA parsing on an already-read frame: the given tokens (after
    trimming whitespace when ``' '`` is a token) become null."""
    out = rows
    trim = any(t.strip() == "" and t != "" for t in tokens)
    for c in cols:
        v = strip_ws(F.col(c)) if trim else F.col(c)
        out = out.withColumn(c, F.when(v.isin(*[t.strip() if trim else t for t in tokens]), None)
                             .otherwise(F.col(c)))
    return out


def split_null_champion(rows: DataFrame) -> DataFrame:
    """Tag rows as player (champion present) or team (champion null) for
    known sides; other rows are dropped."""
    rows = blank_to_null(rows, "champion")
    known = F.col("side").isin(*SIDES)
    kind = F.when(F.col("champion").isNotNull(), F.lit("player")).otherwise(F.lit("team"))
    return rows.where(known).withColumn("row_kind", kind)


def coerce_numeric(c, fill_zero: bool = False, dtype: str = "int"):
    """Lenient numeric parse.  Bad text -> null, or -> 0 with ``fill_zero``."""
    c = F.col(c) if isinstance(c, str) else c
    v = F.trim(c.cast("string")).try_cast("double")
    v = F.when(F.isnan(v), None).otherwise(v)
    if fill_zero:
        v = F.coalesce(v, F.lit(0.0))
    return v.cast(dtype)


def seconds_to_minutes(c):
    """P8."""
    return (F.col(c) if isinstance(c, str) else c).cast("double") / F.lit(60.0)


def with_default_teams(df: DataFrame, *cols: str) -> DataFrame:
    """Blank team names become ``Unknown``."""
    for c in cols:
        df = df.withColumn(c, default_team(c))
    return df


def teams_in_league(rows: DataFrame, league: str) -> DataFrame:
    """P20: distinct non-blank team names of one league."""
    return (rows.where(F.col("league") == league)
            .select(F.col("teamname").alias("team"))
            .where(F.col("team").isNotNull() & (F.col("team") != ""))
            .distinct())
