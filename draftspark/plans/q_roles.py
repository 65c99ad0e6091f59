"""Role statistics, JSON side table and role assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import duck_norm, role_tokens
from ..operators import roles as R
from ..session import scratch_path
from .common import base_matches
from .q_matches import MATCHES_CTES
from .registry import register
from ..sources.fixture import with_ctes

_ROLE_LIST = "['top', 'jng', 'mid', 'bot', 'sup']"

# DuckDB: role statistics from matches (position inside side -> role).
ROLE_STATS_CTE = f"""rs AS (
  SELECT {duck_norm('c')} AS champion, {_ROLE_LIST}[pos] AS role, count(*) AS games FROM (
    SELECT unnest(blue_picks) AS c, unnest(range(1, len(blue_picks) + 1)) AS pos FROM matches
    UNION ALL
    SELECT unnest(red_picks), unnest(range(1, len(red_picks) + 1)) FROM matches)
  WHERE pos <= 5 GROUP BY ALL)"""

# DuckDB brute force of V1: every team x 120 permutations, argmax with the
# lowest permutation number winning ties.
ROLE_ASSIGN_CTES = [ROLE_STATS_CTE, """perms AS (
  SELECT row_number() OVER (ORDER BY a, b, c, d, e) - 1 AS no, [a, b, c, d, e] AS p
  FROM range(5) t1(a), range(5) t2(b), range(5) t3(c), range(5) t4(d), range(5) t5(e)
  WHERE a NOT IN (b, c, d, e) AND b NOT IN (c, d, e) AND c NOT IN (d, e) AND d <> e)""",
    """teams AS (SELECT gameid, 0 AS team, blue_picks AS picks FROM matches
                 UNION ALL SELECT gameid, 1, red_picks FROM matches)""",
    f"""sc AS (
  SELECT t.gameid, t.team, s.pos, r.ri, coalesce(rs.games, 0) AS g
  FROM teams t CROSS JOIN range(5) s(pos) CROSS JOIN range(5) r(ri)
  LEFT JOIN rs ON rs.champion = {duck_norm('t.picks[s.pos + 1]')} AND rs.role = {_ROLE_LIST}[r.ri + 1]
  WHERE len(t.picks) = 5)""",
    """tps AS (
  SELECT sc.gameid, sc.team, pm.no, any_value(pm.p) AS p, sum(sc.g) AS s
  FROM perms pm CROSS JOIN range(5) rr(r)
  JOIN sc ON sc.ri = rr.r AND sc.pos = pm.p[rr.r + 1]
  GROUP BY sc.gameid, sc.team, pm.no)""",
    """best AS (SELECT gameid, team, arg_max(p, {'s': s, 'n': -no}) AS p FROM tps GROUP BY gameid, team)""",
    """sorted AS (
  SELECT t.gameid, t.team,
         CASE WHEN len(t.picks) = 5 THEN list_transform(b.p, lambda i: t.picks[i + 1]) ELSE t.picks END AS s
  FROM teams t LEFT JOIN best b ON b.gameid = t.gameid AND b.team = t.team)""",
    """ra AS (SELECT gameid, max(s) FILTER (WHERE team = 0) AS blue_picks_sorted,
                   max(s) FILTER (WHERE team = 1) AS red_picks_sorted FROM sorted GROUP BY gameid)"""]


def _m(*ctes, select):
    return with_ctes(*MATCHES_CTES, *ctes, select=select)


@register("role_stats_long", _m(ROLE_STATS_CTE, select="SELECT champion, role, games FROM rs"))
def q_role_stats_long(spark, sf):
    """A16 built from matches, written as the nested JSON document and read
    back through the S5 reader (from_json + two explodes)."""
    long = R.role_stats_long(base_matches(spark, sf))
    path = scratch_path(spark, "role_stats_json")
    R.write_role_stats_json(long, path)
    return R.read_role_stats_json(spark, path)


def sorted_matches(spark, sf):
    m = base_matches(spark, sf, reuse=True)
    stats = R.role_stats_long(m).checkpoint(eager=True)
    return R.assign_roles(m, stats)


@register("role_assign", _m(*ROLE_ASSIGN_CTES, select="SELECT gameid, blue_picks_sorted, red_picks_sorted FROM ra"))
def q_role_assign(spark, sf):
    return sorted_matches(spark, sf).select("gameid", "blue_picks_sorted", "red_picks_sorted")


_TOKENS_SQL = f"""
SELECT gameid, list_transform(range(least(len(blue_picks_sorted), 5)),
         lambda i: {_ROLE_LIST}[i + 1] || '_' || {duck_norm('blue_picks_sorted[i + 1]')}) AS blue_tokens,
       list_transform(range(least(len(red_picks_sorted), 5)),
         lambda i: {_ROLE_LIST}[i + 1] || '_' || {duck_norm('red_picks_sorted[i + 1]')}) AS red_tokens
FROM ra"""


@register("role_tokens", _m(*ROLE_ASSIGN_CTES, select=_TOKENS_SQL))
def q_role_tokens(spark, sf):
    s = sorted_matches(spark, sf)
    return s.select("gameid", role_tokens(F.col("blue_picks_sorted")).alias("blue_tokens"),
                    role_tokens(F.col("red_picks_sorted")).alias("red_tokens"))
