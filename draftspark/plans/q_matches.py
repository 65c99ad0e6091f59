"""Queries over participant rows and reconstructed matches (S/P/A1/A3/J1/J2/D5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import duck_norm
from ..operators import matches as M
from ..operators import participants as P
from ..sources.fixture import TOWERS_TEXT_CTE, match_rows, towers_text, with_ctes
from .registry import register

# DuckDB fragments shared by the oracle statements.
ROWS_PN = "r AS (SELECT *, CAST(participantid AS INT) AS pn FROM match_rows)"
PLAYERS = "p AS (SELECT * FROM r WHERE participantid NOT IN ('100', '200'))"


def _first(col: str, cond: str) -> str:
    return f"arg_min({col}, pn) FILTER (WHERE {cond})"


def _picks(cond: str, expr: str = "champion") -> str:
    return f"list({expr} ORDER BY pn) FILTER (WHERE {cond})"


@register("player_rows", with_ctes(select="SELECT * FROM match_rows WHERE participantid NOT IN ('100', '200')"))
def q_player_rows(spark, sf):
    return P.player_rows(match_rows(spark, sf))


@register("team_rows", with_ctes(select="SELECT * FROM match_rows WHERE participantid IN ('100', '200')"))
def q_team_rows(spark, sf):
    return P.team_rows(match_rows(spark, sf))


@register("split_null_champion", with_ctes(select="""
SELECT gameid, side, participantid, NULLIF(champion, '') AS champion,
       CASE WHEN NULLIF(champion, '') IS NOT NULL THEN 'player' ELSE 'team' END AS row_kind
FROM match_rows WHERE side IN ('Blue', 'Red')"""))
def q_split_null_champion(spark, sf):
    return P.split_null_champion(match_rows(spark, sf)).select(
        "gameid", "side", "participantid", "champion", "row_kind")


@register("coerce_numeric", with_ctes(TOWERS_TEXT_CTE, select="""
SELECT gameid, participantid, towers AS towers_text,
       CAST(TRY_CAST(trim(towers) AS DOUBLE) AS INT) AS towers_or_null,
       CAST(coalesce(TRY_CAST(trim(towers) AS DOUBLE), 0) AS INT) AS towers_or_zero
FROM towers_text"""))
def q_coerce_numeric(spark, sf):
    t = towers_text(match_rows(spark, sf))
    return t.select("gameid", "participantid", F.col("towers").alias("towers_text"),
                    P.coerce_numeric("towers").alias("towers_or_null"),
                    P.coerce_numeric("towers", fill_zero=True).alias("towers_or_zero"))


@register("match_minutes", with_ctes(select="""
SELECT DISTINCT gameid, CAST(gamelength AS DOUBLE) / 60.0 AS minutes FROM match_rows"""))
def q_match_minutes(spark, sf):
    r = match_rows(spark, sf)
    return r.select("gameid", P.seconds_to_minutes("gamelength").alias("minutes")).distinct()


@register("teams_in_league", with_ctes(select="""
SELECT DISTINCT teamname AS team FROM match_rows
WHERE league = 'NATION_7' AND teamname IS NOT NULL AND teamname <> ''"""))
def q_teams_in_league(spark, sf):
    return P.teams_in_league(match_rows(spark, sf), "NATION_7")


_MG = f"""mg AS (
  SELECT gameid, count(*) AS n, count(*) FILTER (WHERE side = 'Blue') AS nb,
         count(*) FILTER (WHERE side = 'Red') AS nr,
         {_picks("side = 'Blue'")} AS blue_picks, {_picks("side = 'Red'")} AS red_picks,
         {_first('teamname', "side = 'Blue'")} AS blue_team, {_first('teamname', "side = 'Red'")} AS red_team,
         CAST({_first('result', "side = 'Blue'")} AS INT) AS result,
         {_first('date', "side = 'Blue'")} AS date,
         CAST(sum(kills) AS DOUBLE) AS total_kills,
         CAST({_first('gamelength', "side = 'Blue'")} AS DOUBLE) AS gamelength
  FROM p GROUP BY gameid)"""

# DuckDB CTE chain ending in ``matches`` (A1), reused by downstream oracles.
MATCHES_CTES = (ROWS_PN, PLAYERS, _MG, """matches AS (
  SELECT gameid, blue_picks, red_picks, blue_team, red_team, result, date, 1 AS blue_side,
         total_kills, gamelength
  FROM mg WHERE n = 10 AND nb = 5 AND nr = 5)""")

_MATCHES_SQL = with_ctes(*MATCHES_CTES, select="SELECT * FROM matches")


@register("matches", _MATCHES_SQL)
def q_matches(spark, sf):
    return M.matches(match_rows(spark, sf))


@register("matches_kills", with_ctes(ROWS_PN, PLAYERS, f"""g AS (
  SELECT gameid, count(*) AS n, count(*) FILTER (WHERE side = 'Blue') AS nb,
         count(*) FILTER (WHERE side = 'Red') AS nr,
         {_picks("side = 'Blue'")} AS blue_picks, {_picks("side = 'Red'")} AS red_picks,
         {_first('teamname', "side = 'Blue'")} AS blue_team, {_first('teamname', "side = 'Red'")} AS red_team,
         CAST({_first('result', "side = 'Blue'")} AS INT) AS blue_wins,
         CAST(sum(kills) AS BIGINT) AS total_kills,
         {_first('date', "side = 'Blue'")} AS date
  FROM p GROUP BY gameid)""", select="""
SELECT gameid, blue_picks, red_picks, blue_team, red_team, blue_wins, total_kills, 1 AS blue_side, date
FROM g WHERE n = 10 AND nb > 0 AND nr > 0"""))
def q_matches_kills(spark, sf):
    return M.matches_kills(match_rows(spark, sf))


def _all_rows_sql(extra: str, out: str) -> str:
    return with_ctes(ROWS_PN, f"""g AS (
  SELECT gameid, count(*) FILTER (WHERE participantid NOT IN ('100', '200')) AS n,
         count(*) FILTER (WHERE side = 'Blue') AS nb, count(*) FILTER (WHERE side = 'Red') AS nr,
         {_picks("side = 'Blue' AND participantid NOT IN ('100', '200')")} AS blue_picks,
         {_picks("side = 'Red' AND participantid NOT IN ('100', '200')")} AS red_picks,
         {_first('teamname', "side = 'Blue'")} AS blue_team, {_first('teamname', "side = 'Red'")} AS red_team,
         CAST({_first('result', "side = 'Blue'")} AS INT) AS blue_wins,
         {_first('date', "side = 'Blue'")} AS date, {extra}
  FROM r GROUP BY gameid)""", select=f"""
SELECT gameid, blue_picks, red_picks, blue_team, red_team, {out}, blue_wins, 1 AS blue_side, date
FROM g WHERE n = 10 AND nb > 0 AND nr > 0""")


@register("matches_minutes", _all_rows_sql(
    f"CAST({_first('gamelength', "side = 'Blue'")} AS INT) / 60.0 AS gamelength_min",
    "gamelength_min"))
def q_matches_minutes(spark, sf):
    return M.matches_minutes(match_rows(spark, sf))


@register("matches_turrets", _all_rows_sql(
    "CAST(sum(CAST(coalesce(TRY_CAST(trim(CAST(towers AS VARCHAR)) AS DOUBLE), 0) AS BIGINT)) AS BIGINT)"
    " AS total_turrets", "total_turrets"))
def q_matches_turrets(spark, sf):
    return M.matches_turrets(match_rows(spark, sf))


@register("matches_length", with_ctes(ROWS_PN, PLAYERS, f"""g AS (
  SELECT gameid, count(*) AS n, count(*) FILTER (WHERE side = 'Blue') AS nb,
         count(*) FILTER (WHERE side = 'Red') AS nr,
         {_picks("side = 'Blue'", "__NORM__")} AS blue_picks, {_picks("side = 'Red'", "__NORM__")} AS red_picks,
         {_first('teamname', "side = 'Blue'")} AS blue_team, {_first('teamname', "side = 'Red'")} AS red_team,
         CAST(arg_min(gamelength, pn) AS INT) AS gamelength
  FROM p GROUP BY gameid)""", select="""
SELECT gameid, blue_picks, red_picks, blue_team, red_team, gamelength
FROM g WHERE n = 10 AND nb > 0 AND nr > 0""").replace("__NORM__", duck_norm("champion")))
def q_matches_length(spark, sf):
    return M.matches_length(match_rows(spark, sf))


@register("matches_team_kills", with_ctes(ROWS_PN, """k AS (
  SELECT *, NULLIF(champion, '') AS champ,
         CAST(TRY_CAST(trim(CAST(kills AS VARCHAR)) AS DOUBLE) AS BIGINT) AS k
  FROM r WHERE side IN ('Blue', 'Red'))""", f"""g AS (
  SELECT gameid,
         count(*) FILTER (WHERE champ IS NOT NULL) AS n, count(*) FILTER (WHERE champ IS NULL) AS nt,
         count(*) FILTER (WHERE champ IS NOT NULL AND lower(side) = 'blue') AS nb,
         count(*) FILTER (WHERE champ IS NOT NULL AND lower(side) = 'red') AS nr,
         count(*) FILTER (WHERE champ IS NULL AND lower(side) = 'blue') AS ntb,
         count(*) FILTER (WHERE champ IS NULL AND lower(side) = 'red') AS ntr,
         {_picks("champ IS NOT NULL AND lower(side) = 'blue'")} AS blue_picks,
         {_picks("champ IS NOT NULL AND lower(side) = 'red'")} AS red_picks,
         {_first('teamname', "champ IS NULL AND lower(side) = 'blue'")} AS blue_team,
         {_first('teamname', "champ IS NULL AND lower(side) = 'red'")} AS red_team,
         {_first('k', "champ IS NULL AND lower(side) = 'blue'")} AS bk,
         {_first('k', "champ IS NULL AND lower(side) = 'red'")} AS rk
  FROM k GROUP BY gameid)""", select="""
SELECT gameid, blue_picks, red_picks, blue_team, red_team, bk + rk AS total_kills
FROM g WHERE n = 10 AND nt = 2 AND nb = 5 AND nr = 5 AND ntb > 0 AND ntr > 0
  AND bk IS NOT NULL AND rk IS NOT NULL"""))
def q_matches_team_kills(spark, sf):
    return M.matches_team_kills(match_rows(spark, sf))


_TR = "participantid IN ('100', '200')"
_PL = "participantid NOT IN ('100', '200')"


@register("matches_towers", with_ctes(ROWS_PN, """t AS (
  SELECT *, CAST(TRY_CAST(trim(CAST(towers AS VARCHAR)) AS DOUBLE) AS BIGINT) AS tw FROM r)""", f"""g AS (
  SELECT gameid, count(*) FILTER (WHERE {_PL}) AS n, count(*) FILTER (WHERE {_TR}) AS nt,
         count(*) FILTER (WHERE {_PL} AND side = 'Blue') AS nb,
         count(*) FILTER (WHERE {_PL} AND side = 'Red') AS nr,
         count(*) FILTER (WHERE {_TR} AND side = 'Blue') AS ntb,
         count(*) FILTER (WHERE {_TR} AND side = 'Red') AS ntr,
         {_picks(f"{_PL} AND side = 'Blue'")} AS blue_picks,
         {_picks(f"{_PL} AND side = 'Red'")} AS red_picks,
         {_first('teamname', f"{_TR} AND side = 'Blue'")} AS blue_team,
         {_first('teamname', f"{_TR} AND side = 'Red'")} AS red_team,
         {_first('tw', f"{_TR} AND side = 'Blue'")} AS bt,
         {_first('tw', f"{_TR} AND side = 'Red'")} AS rt,
         {_first('date', f"{_TR} AND side = 'Blue'")} AS date
  FROM t GROUP BY gameid)""", select="""
SELECT gameid, blue_picks, red_picks, blue_team, red_team, bt + rt AS towers_total, date
FROM g WHERE n = 10 AND nt = 2 AND nb = 5 AND nr = 5 AND ntb > 0 AND ntr > 0
  AND bt IS NOT NULL AND rt IS NOT NULL"""))
def q_matches_towers(spark, sf):
    return M.matches_towers(match_rows(spark, sf))


@register("matches_flags", with_ctes(ROWS_PN, PLAYERS, f"""g AS (
  SELECT gameid, count(*) AS n, count(*) FILTER (WHERE side = 'Blue') AS nb,
         count(*) FILTER (WHERE side = 'Red') AS nr,
         {_picks("side = 'Blue'")} AS blue_picks, {_picks("side = 'Red'")} AS red_picks,
         {_first('teamname', "side = 'Blue'")} AS blue_team, {_first('teamname', "side = 'Red'")} AS red_team,
         CAST({_first('result', "side = 'Blue'")} AS INT) AS result,
         {_first('date', "side = 'Blue'")} AS date
  FROM p GROUP BY gameid)""", select="""
SELECT gameid, blue_picks, red_picks, blue_team, red_team, 1 AS blue_side, 0 AS red_side, result, date
FROM g WHERE n = 10 AND nb = 5 AND nr = 5"""))
def q_matches_flags(spark, sf):
    return M.matches_flags(match_rows(spark, sf))


_COUNTS = f"""c AS (
  SELECT gameid, count(*) FILTER (WHERE {_PL}) AS n_players,
         count(*) FILTER (WHERE {_PL} AND side = 'Blue') AS n_blue,
         count(*) FILTER (WHERE {_PL} AND side = 'Red') AS n_red,
         count(*) FILTER (WHERE {_TR}) AS n_team_rows
  FROM match_rows GROUP BY gameid)"""


@register("complete_games", with_ctes(_COUNTS, select="""
SELECT * FROM c WHERE n_players = 10 AND n_blue = 5 AND n_red = 5 AND n_team_rows = 2"""))
def q_complete_games(spark, sf):
    return M.complete_games(match_rows(spark, sf))


@register("rejected_games", with_ctes(_COUNTS, select="""
SELECT gameid, n_players, n_blue, n_red,
       CASE WHEN n_players <> 10 THEN 'players_not_10'
            WHEN n_blue = 0 OR n_red = 0 THEN 'one_sided'
            ELSE 'sides_not_5v5' END AS reason
FROM c WHERE n_players <> 10 OR n_blue <> 5 OR n_red <> 5"""))
def q_rejected_games(spark, sf):
    return M.rejected_games(match_rows(spark, sf))


@register("kill_totals", with_ctes(select=f"""
SELECT gameid, CAST(sum(kills) FILTER (WHERE {_PL}) AS BIGINT) AS player_kills,
       CAST(sum(kills) FILTER (WHERE {_TR} AND side IN ('Blue', 'Red')) AS BIGINT) AS team_kills,
       CAST(sum(kills) AS BIGINT) AS all_kills
FROM match_rows GROUP BY gameid"""))
def q_kill_totals(spark, sf):
    return M.kill_totals(match_rows(spark, sf))


@register("sides_join", with_ctes(ROWS_PN, PLAYERS, select=f"""
SELECT * FROM (
  SELECT gameid, {_first('teamname', "side = 'Blue'")} AS blue_team,
         {_first('teamname', "side = 'Red'")} AS red_team,
         CAST(sum(kills) FILTER (WHERE side = 'Blue') AS BIGINT) AS blue_kills,
         CAST(sum(kills) FILTER (WHERE side = 'Red') AS BIGINT) AS red_kills,
         count(*) FILTER (WHERE side = 'Blue') AS blue_players,
         count(*) FILTER (WHERE side = 'Red') AS red_players
  FROM p GROUP BY gameid) WHERE blue_players > 0 AND red_players > 0"""))
def q_sides_join(spark, sf):
    return M.sides_join(match_rows(spark, sf))


@register("player_team_join", with_ctes(f"""sides AS (
  SELECT gameid, side, participantid, champion, kills, {_PL} AS is_player,
         count(*) FILTER (WHERE {_TR}) OVER s AS n_team, max(kills) FILTER (WHERE {_TR}) OVER s AS team_kills,
         max(towers) FILTER (WHERE {_TR}) OVER s AS team_towers
  FROM match_rows WINDOW s AS (PARTITION BY gameid, side))""", select="""
SELECT gameid, participantid, side, champion, kills, team_kills, team_towers
FROM sides WHERE is_player AND n_team > 0"""))
def q_player_team_join(spark, sf):
    return M.player_team_join(match_rows(spark, sf))
