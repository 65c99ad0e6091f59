"""Match reconstruction (A1 and its loader variants, A2, A3, P5, D5, J1, J2).

Long participant rows (ten players plus two team rows per game) become one
row per game.  Every variant has two parts, so that no unbounded group ever
meets in one task:

1. a *partial* aggregate per game (counts, sums, ``min_by`` first values) -
   map-side combined, so a game key holding a third of all rows costs one
   small partial row per map task;
2. picks are gathered from at most eleven player rows of a game: a rank filter
   that Spark applies in the map tasks already (a partial window group limit),
   as a game with more than ten players is rejected by part 1 anyway.

Pick order is the participant number, never the arrival order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import normalize_name
from .participants import coerce_numeric, is_team_row, player_rows, team_rows

def _pn() -> Column:
    return F.col("participantid").cast("int")


def _count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


def _first(col: str | Column, cond: Column) -> Column:
    """A2: value of the first row (lowest participant number) meeting ``cond``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.min_by(c, F.when(cond, _pn()))


def _ordered_picks(cond: Column, normalize: bool = False) -> Column:
    champ = normalize_name("champion") if normalize else F.col("champion")
    item = F.when(cond, F.struct(_pn().alias("pn"), champ.alias("c")))
    return F.transform(F.array_sort(F.collect_list(item)), lambda x: x["c"])


def first_rows(players: DataFrame, most: int = 11) -> DataFrame:
    """At most ``most`` rows of each game, by participant number.  The rank
    filter runs before the shuffle too, so a hot game sends ``most`` rows a task."""
    rank = F.row_number().over(Window.partitionBy("gameid").orderBy(_pn()))
    return players.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def _picks(players: DataFrame, blue: Column, red: Column, normalize: bool = False) -> DataFrame:
    """Part 2: ordered pick arrays (whole for games of ten players)."""
    return (first_rows(players).groupBy("gameid")
            .agg(_ordered_picks(blue, normalize).alias("blue_picks"),
                 _ordered_picks(red, normalize).alias("red_picks")))


def _assemble(stats: DataFrame, picks: DataFrame, cols: list[str]) -> DataFrame:
    return stats.join(picks, "gameid").select(*cols)


def _blue() -> Column:
    return F.col("side") == "Blue"


def _red() -> Column:
    return F.col("side") == "Red"


def matches(rows: DataFrame) -> DataFrame:
    """A1: winner/kills loader.  Ten player rows, five per side."""
    players = player_rows(rows)
    stats = (players.groupBy("gameid").agg(
        F.count(F.lit(1)).alias("n"), _count_if(_blue()).alias("nb"), _count_if(_red()).alias("nr"),
        _first("teamname", _blue()).alias("blue_team"), _first("teamname", _red()).alias("red_team"),
        _first(F.col("result").cast("int"), _blue()).alias("result"), _first("date", _blue()).alias("date"),
        F.sum(F.col("kills").cast("double")).alias("total_kills"),
        _first(F.col("gamelength").cast("double"), _blue()).alias("gamelength"))
        .where("n = 10 AND nb = 5 AND nr = 5"))
    return _assemble(stats, _picks(players, _blue(), _red()),
                     ["gameid", "blue_picks", "red_picks", "blue_team", "red_team", "result",
                      "date", F.lit(1).alias("blue_side"), "total_kills", "gamelength"])


def matches_kills(rows: DataFrame) -> DataFrame:
    """Ten player rows, both sides present (no 5v5 rule)."""
    players = player_rows(rows)
    stats = (players.groupBy("gameid").agg(
        F.count(F.lit(1)).alias("n"), _count_if(_blue()).alias("nb"), _count_if(_red()).alias("nr"),
        _first("teamname", _blue()).alias("blue_team"), _first("teamname", _red()).alias("red_team"),
        _first(F.col("result").cast("int"), _blue()).alias("blue_wins"),
        F.sum(F.col("kills").cast("bigint")).alias("total_kills"),
        _first("date", _blue()).alias("date"))
        .where("n = 10 AND nb > 0 AND nr > 0"))
    return _assemble(stats, _picks(players, _blue(), _red()),
                     ["gameid", "blue_picks", "red_picks", "blue_team", "red_team", "blue_wins",
                      "total_kills", F.lit(1).alias("blue_side"), "date"])


def _all_rows_stats(rows: DataFrame, extra: list[Column]) -> DataFrame:
    """Minutes/turret loaders: the player count decides, but the side data
    (first row, presence) come from every row of the side."""
    return (rows.groupBy("gameid").agg(
        _count_if(~is_team_row()).alias("n"), _count_if(_blue()).alias("nb"), _count_if(_red()).alias("nr"),
        _first("teamname", _blue()).alias("blue_team"), _first("teamname", _red()).alias("red_team"),
        _first(F.col("result").cast("int"), _blue()).alias("blue_wins"),
        _first("date", _blue()).alias("date"), *extra)
        .where("n = 10 AND nb > 0 AND nr > 0"))


def matches_minutes(rows: DataFrame) -> DataFrame:
    """Game length in minutes (picks from player rows only, quirk Q2 fixed)."""
    stats = _all_rows_stats(rows, [
        (_first(F.col("gamelength").cast("int"), _blue()) / F.lit(60.0)).alias("gamelength_min")])
    return _assemble(stats, _picks(player_rows(rows), _blue(), _red()),
                     ["gameid", "blue_picks", "red_picks", "blue_team", "red_team", "gamelength_min",
                      "blue_wins", F.lit(1).alias("blue_side"), "date"])


def matches_turrets(rows: DataFrame) -> DataFrame:
    """A1d: turrets summed over all rows of the game; bad text counts 0."""
    stats = _all_rows_stats(rows, [
        F.sum(coerce_numeric("towers", fill_zero=True, dtype="bigint")
              ).alias("total_turrets")])
    return _assemble(stats, _picks(player_rows(rows), _blue(), _red()),
                     ["gameid", "blue_picks", "red_picks", "blue_team", "red_team", "total_turrets",
                      "blue_wins", F.lit(1).alias("blue_side"), "date"])


def matches_length(rows: DataFrame) -> DataFrame:
    """A1e: seconds, normalized picks, no date; first player row's length."""
    players = player_rows(rows)
    stats = (players.groupBy("gameid").agg(
        F.count(F.lit(1)).alias("n"), _count_if(_blue()).alias("nb"), _count_if(_red()).alias("nr"),
        _first("teamname", _blue()).alias("blue_team"), _first("teamname", _red()).alias("red_team"),
        F.min_by(F.col("gamelength").cast("int"), _pn()).alias("gamelength"))
        .where("n = 10 AND nb > 0 AND nr > 0"))
    return _assemble(stats, _picks(players, _blue(), _red(), normalize=True),
                     ["gameid", "blue_picks", "red_picks", "blue_team", "red_team", "gamelength"])


def matches_team_kills(rows: DataFrame) -> DataFrame:
    """A1f: total kills from the two team rows.  Rows split by null champion
    (blank read as null, S4) for the known sides (P3); sides compared
    case-insensitively for picks and team rows (P4)."""
    champ = F.nullif(F.col("champion"), F.lit(""))
    known = F.col("side").isin("Blue", "Red")
    is_player = champ.isNotNull() & known
    is_team = champ.isNull() & known
    lblue = F.lower("side") == "blue"
    lred = F.lower("side") == "red"
    kills = coerce_numeric("kills", dtype="bigint")
    scoped = rows.where(known)
    stats = (scoped.groupBy("gameid").agg(
        _count_if(is_player).alias("n"), _count_if(is_team).alias("nt"),
        _count_if(is_player & lblue).alias("nb"), _count_if(is_player & lred).alias("nr"),
        _count_if(is_team & lblue).alias("ntb"), _count_if(is_team & lred).alias("ntr"),
        _first("teamname", is_team & lblue).alias("blue_team"),
        _first("teamname", is_team & lred).alias("red_team"),
        _first(kills, is_team & lblue).alias("bk"), _first(kills, is_team & lred).alias("rk"))
        .where("n = 10 AND nt = 2 AND nb = 5 AND nr = 5 AND ntb > 0 AND ntr > 0 "
               "AND bk IS NOT NULL AND rk IS NOT NULL")
        .withColumn("total_kills", F.col("bk") + F.col("rk")))
    players = scoped.where(is_player)
    return _assemble(stats, _picks(players, lblue, lred),
                     ["gameid", "blue_picks", "red_picks", "blue_team", "red_team", "total_kills"])


def matches_towers(rows: DataFrame) -> DataFrame:
    """A1g: total towers from the two team rows (NA tokens '' and ' ')."""
    towers = coerce_numeric("towers", dtype="bigint")
    tr = is_team_row()
    stats = (rows.groupBy("gameid").agg(
        _count_if(~tr).alias("n"), _count_if(tr).alias("nt"),
        _count_if(~tr & _blue()).alias("nb"), _count_if(~tr & _red()).alias("nr"),
        _count_if(tr & _blue()).alias("ntb"), _count_if(tr & _red()).alias("ntr"),
        _first("teamname", tr & _blue()).alias("blue_team"), _first("teamname", tr & _red()).alias("red_team"),
        _first(towers, tr & _blue()).alias("bt"), _first(towers, tr & _red()).alias("rt"),
        _first("date", tr & _blue()).alias("date"))
        .where("n = 10 AND nt = 2 AND nb = 5 AND nr = 5 AND ntb > 0 AND ntr > 0 "
               "AND bt IS NOT NULL AND rt IS NOT NULL")
        .withColumn("towers_total", F.col("bt") + F.col("rt")))
    return _assemble(stats, _picks(player_rows(rows), _blue(), _red()),
                     ["gameid", "blue_picks", "red_picks", "blue_team", "red_team", "towers_total", "date"])


def matches_flags(rows: DataFrame) -> DataFrame:
    """A1h: winner loader with both side flags."""
    players = player_rows(rows)
    stats = (players.groupBy("gameid").agg(
        F.count(F.lit(1)).alias("n"), _count_if(_blue()).alias("nb"), _count_if(_red()).alias("nr"),
        _first("teamname", _blue()).alias("blue_team"), _first("teamname", _red()).alias("red_team"),
        _first(F.col("result").cast("int"), _blue()).alias("result"), _first("date", _blue()).alias("date"))
        .where("n = 10 AND nb = 5 AND nr = 5"))
    return _assemble(stats, _picks(players, _blue(), _red()),
                     ["gameid", "blue_picks", "red_picks", "blue_team", "red_team",
                      F.lit(1).alias("blue_side"), F.lit(0).alias("red_side"), "result", "date"])


LOADERS = {
    "winner": matches, "kills": matches_kills, "minutes": matches_minutes,
    "turrets": matches_turrets, "length": matches_length, "team_kills": matches_team_kills,
    "towers": matches_towers, "flags": matches_flags,
}


def game_counts(rows: DataFrame) -> DataFrame:
    """Per-game row counts (map-side combined)."""
    tr = is_team_row()
    return rows.groupBy("gameid").agg(
        _count_if(~tr).alias("n_players"), _count_if(~tr & _blue()).alias("n_blue"),
        _count_if(~tr & _red()).alias("n_red"), _count_if(tr).alias("n_team_rows"))


def complete_games(rows: DataFrame) -> DataFrame:
    """P5: 10 players, 5 + 5, both team rows present."""
    return game_counts(rows).where(
        "n_players = 10 AND n_blue = 5 AND n_red = 5 AND n_team_rows = 2")


def rejected_games(rows: DataFrame) -> DataFrame:
    """Games the winner loader drops, with the first failing rule."""
    c = game_counts(rows)
    reason = (F.when(F.col("n_players") != 10, F.lit("players_not_10"))
              .when((F.col("n_blue") == 0) | (F.col("n_red") == 0), F.lit("one_sided"))
              .when((F.col("n_blue") != 5) | (F.col("n_red") != 5), F.lit("sides_not_5v5")))
    return (c.withColumn("reason", reason).where(F.col("reason").isNotNull())
            .select("gameid", "n_players", "n_blue", "n_red", "reason"))


def kill_totals(rows: DataFrame) -> DataFrame:
    """A3: kills summed over players, over the two team rows, over all rows."""
    k = F.col("kills").cast("bigint")
    tr = is_team_row()
    return rows.groupBy("gameid").agg(
        F.sum(F.when(~tr, k)).alias("player_kills"),
        F.sum(F.when(tr & F.col("side").isin("Blue", "Red"), k)).alias("team_kills"),
        F.sum(k).alias("all_kills"))


def sides_join(rows: DataFrame) -> DataFrame:
    """Blue and red halves of a game side by side (conditional
    aggregation: one shuffle, no self join)."""
    p = player_rows(rows)
    k = F.col("kills").cast("bigint")
    return (p.groupBy("gameid").agg(
        _first("teamname", _blue()).alias("blue_team"), _first("teamname", _red()).alias("red_team"),
        F.sum(F.when(_blue(), k)).alias("blue_kills"), F.sum(F.when(_red(), k)).alias("red_kills"),
        _count_if(_blue()).alias("blue_players"), _count_if(_red()).alias("red_players"))
        .where("blue_players > 0 AND red_players > 0"))


def player_team_join(rows: DataFrame) -> DataFrame:
    """Each player row with its side's team row (kills and towers)."""
    t = team_rows(rows).select("gameid", "side", F.col("kills").alias("team_kills"),
                               F.col("towers").alias("team_towers"))
    return (player_rows(rows).join(t, ["gameid", "side"])
            .select("gameid", "participantid", "side", "champion", "kills", "team_kills", "team_towers"))
