"""Ordinal, weights, folds, splits and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import duck_hash
from ..operators import labels as L
from ..operators import ordering as O
from ..operators.matches import matches_kills, matches_team_kills, matches_turrets
from ..sources.fixture import match_rows, with_ctes
from .common import base_matches, round_doubles
from .q_matches import MATCHES_CTES
from .registry import ORACLE, register


def _m(*ctes, select):
    return with_ctes(*MATCHES_CTES, *ctes, select=select)


_ORD = """o AS (SELECT gameid, date, result,
  row_number() OVER (ORDER BY date, CAST(gameid AS BIGINT)) - 1 AS ordinal,
  count(*) OVER () AS n FROM matches)"""


@register("match_ordinal", _m(_ORD, select="SELECT gameid, date, ordinal FROM o"))
def q_match_ordinal(spark, sf):
    return O.with_ordinal(base_matches(spark, sf)).select("gameid", "date", "ordinal")


@register("recency_weight", _m(_ORD, select="""
SELECT gameid, ordinal, round(CASE WHEN n = 1 THEN 0.1 ELSE 0.1 + 0.9 * ordinal / (n - 1) END, 6) AS weight
FROM o"""))
def q_recency_weight(spark, sf):
    m = O.with_ordinal(base_matches(spark, sf))
    n = m.count()
    return round_doubles(O.recency_weight(m, n, 0.1, 1.0).select("gameid", "ordinal", "weight"))


@register("time_folds", _m(_ORD, """f AS (SELECT unnest(range(3)) AS fold)""", select="""
SELECT gameid, CAST(fold AS INT) AS fold,
       CASE WHEN ordinal < n - (3 - fold) * (n // 4) THEN 'train' ELSE 'test' END AS role
FROM o CROSS JOIN f
WHERE ordinal < n - (3 - fold - 1) * (n // 4)"""))
def q_time_folds(spark, sf):
    m = O.with_ordinal(base_matches(spark, sf))
    return O.time_folds(m, m.count(), 3).select("gameid", "fold", "role")


@register("tail_split", _m(_ORD, select="""
SELECT gameid, CASE WHEN ordinal < n - CAST(ceil(0.2 * n) AS BIGINT) THEN 'train' ELSE 'test' END AS split
FROM o"""))
def q_tail_split(spark, sf):
    """W4, test part = ceil(0.2 n) latest matches."""
    m = O.with_ordinal(base_matches(spark, sf))
    return O.tail_split(m, m.count(), 0.2).select("gameid", "split")


@register("hash_split", _m(select=f"""
SELECT gameid, CASE WHEN {duck_hash("gameid || '#42'")} % 100 < 80 THEN 'train' ELSE 'test' END AS split
FROM matches"""))
def q_hash_split(spark, sf):
    return O.hash_split(base_matches(spark, sf), "gameid", 42, 80).select("gameid", "split")


@register("stratified_folds", _m(select=f"""
SELECT gameid, result,
       CAST((row_number() OVER (PARTITION BY result ORDER BY {duck_hash("gameid || '#42'")}, gameid) - 1) % 3 AS INT)
         AS fold
FROM matches"""))
def q_stratified_folds(spark, sf):
    return O.stratified_folds(base_matches(spark, sf), "gameid", "result", 3, 42).select("gameid", "result", "fold")


_KILL_SPEC_SQL = ", ".join(f"('{n}', {t})" for n, t in L.kill_labels())


@register("over_labels_long", with_ctes(
    "r AS (SELECT *, CAST(participantid AS INT) AS pn FROM match_rows)",
    """k AS (SELECT gameid, count(*) FILTER (WHERE participantid NOT IN ('100', '200')) AS n,
                  count(*) FILTER (WHERE participantid NOT IN ('100', '200') AND side = 'Blue') AS nb,
                  count(*) FILTER (WHERE participantid NOT IN ('100', '200') AND side = 'Red') AS nr,
                  CAST(sum(kills) FILTER (WHERE participantid NOT IN ('100', '200')) AS BIGINT) AS total_kills
           FROM r GROUP BY gameid)""",
    f"""spec AS (SELECT * FROM (VALUES {_KILL_SPEC_SQL}) t(label, threshold))""",
    select="""
SELECT gameid, total_kills, label, CAST(threshold AS DOUBLE) AS threshold,
       CASE WHEN total_kills > threshold THEN 1 ELSE 0 END AS over
FROM k CROSS JOIN spec WHERE n = 10 AND nb > 0 AND nr > 0"""))
def q_over_labels_long(spark, sf):
    """P10 on the kills loader: 15 kill thresholds."""
    m = matches_kills(match_rows(spark, sf))
    return L.over_labels_long(m, "total_kills", L.kill_labels())


def _wide_cols(spec, measure):
    return ", ".join(f"CASE WHEN {measure} > {t} THEN 1 ELSE 0 END AS {n}" for n, t in spec)


@register("over_labels_wide", f"""SELECT gameid, total_kills, {_wide_cols(L.kill_labels(), 'total_kills')}
FROM ({ORACLE['matches_team_kills']}) t""")
def q_over_labels_wide(spark, sf):
    """P11 on the team-kill loader (wide columns)."""
    m = matches_team_kills(match_rows(spark, sf))
    return L.over_labels_wide(m.select("gameid", "total_kills"), "total_kills", L.kill_labels())


@register("turret_labels", f"""SELECT gameid, total_turrets, {_wide_cols(L.turret_labels(), 'total_turrets')}
FROM ({ORACLE['matches_turrets']}) t""")
def q_turret_labels(spark, sf):
    """P10/Q6 on the turret loader: ``over_10_5`` means ``> 10``."""
    m = matches_turrets(match_rows(spark, sf))
    return L.over_labels_wide(m.select("gameid", "total_turrets"), "total_turrets", L.turret_labels())
