"""Scoring mechanics with exact oracles.

Model outputs are replaced by deterministic scores (see ``q_evaluate``) so
the scoring plan's validation, defaults, counterfactual stacking, winner
fields, threshold maps and quality checks are checked against DuckDB.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import duck_norm, duck_strip, normalize_name
from ..models import score as S
from ..operators import encoders as E
from ..operators.roles import role_stats_long
from ..sources.fixture import DRAFTS_CTE, drafts, match_rows, with_ctes
from .common import base_matches, round_doubles
from .q_evaluate import _SCORED, bround_sql, champ_features
from .q_features import _WIN_APP, _sigmoid_sql
from .q_matches import MATCHES_CTES
from .registry import register

_BOTH = "blue_picks || red_picks"
_VALIDATE = f"""chk AS (
  SELECT *, CASE
    WHEN len(blue_picks) <> 5 OR len(red_picks) <> 5 THEN 'Each side needs exactly five picks.'
    WHEN len(list_filter({_BOTH}, lambda x: x IS NOT NULL AND {duck_strip('x')} <> '')) <> 10
      THEN 'Every pick slot must be filled.'
    WHEN len(list_distinct(list_transform({_BOTH}, lambda x: {duck_norm('x')}))) <> 10
      THEN 'A champion can only be picked once.' END AS error
  FROM drafts)"""
_PREP = f"""prep AS (
  SELECT draft_id, list_transform(blue_picks, lambda c: {duck_norm('c')}) AS blue_picks,
         list_transform(red_picks, lambda c: {duck_norm('c')}) AS red_picks,
         coalesce(NULLIF({duck_strip('blue_team')}, ''), 'Unknown') AS blue_team,
         coalesce(NULLIF({duck_strip('red_team')}, ''), 'Unknown') AS red_team
  FROM chk WHERE error IS NULL)"""


def _d(*ctes, select):
    return with_ctes(DRAFTS_CTE, _VALIDATE, *ctes, select=select)


def _drafts(spark, sf):
    return drafts(match_rows(spark, sf))


@register("validate_drafts", _d(select="SELECT draft_id, error FROM chk"))
def q_validate_drafts(spark, sf):
    """5 + 5 picks, all filled, all distinct; else an error row."""
    return S.validate_drafts(_drafts(spark, sf)).select("draft_id", "error")


@register("default_team", _d(_PREP, select="SELECT draft_id, blue_team, red_team, blue_picks, red_picks FROM prep"))
def q_default_team(spark, sf):
    """P13 + F1 on valid drafts: blank team -> Unknown, picks title-cased."""
    v = S.validate_drafts(_drafts(spark, sf)).where("error IS NULL").drop("error")
    return S.prepare_drafts(v).select("draft_id", "blue_team", "red_team", "blue_picks", "red_picks")


@register("counterfactual_rows", _d(_PREP, select="""
SELECT draft_id, 0 AS variant, blue_team, red_team FROM prep
UNION ALL SELECT draft_id, 1, 'Unknown', 'Unknown' FROM prep"""))
def q_counterfactual_rows(spark, sf):
    """Each valid draft as given and with both teams Unknown."""
    v = S.prepare_drafts(S.validate_drafts(_drafts(spark, sf)).where("error IS NULL").drop("error"))
    return S.counterfactual_rows(v).select("draft_id", "variant", "blue_team", "red_team")


@register("counterfactual_delta", with_ctes(*MATCHES_CTES, *_sigmoid_sql(_WIN_APP, 15.0), DRAFTS_CTE, _VALIDATE, _PREP,
                                            """cr AS (
  SELECT draft_id, 0 AS variant, blue_team, red_team FROM prep
  UNION ALL SELECT draft_id, 1, 'Unknown', 'Unknown' FROM prep)""", """ce AS (
  SELECT cr.draft_id, cr.variant, coalesce(eb.enc, pr.prior) - coalesce(er.enc, pr.prior) AS edge
  FROM cr CROSS JOIN pr LEFT JOIN enc eb ON eb.team = cr.blue_team LEFT JOIN enc er ON er.team = cr.red_team)""",
                                            select="""
SELECT draft_id, round(max(edge) FILTER (WHERE variant = 0), 6) AS edge_with_teams,
       round(max(edge) FILTER (WHERE variant = 1), 6) AS edge_without_teams,
       round(max(edge) FILTER (WHERE variant = 0) - max(edge) FILTER (WHERE variant = 1), 6) AS delta
FROM ce GROUP BY draft_id"""))
def q_counterfactual_delta(spark, sf):
    """B3 on a fixed score: team-strength edge (V4 fitted on matches) of each
    draft with and without teams; both variants scored in one plan."""
    model = E.TeamStrengthEncoder(smoothing=15.0).fit(base_matches(spark, sf))
    v = S.prepare_drafts(S.validate_drafts(_drafts(spark, sf)).where("error IS NULL").drop("error"))
    rows = model.transform(S.counterfactual_rows(v)).withColumn(
        "edge", F.col("blue_team_strength") - F.col("red_team_strength"))
    v0 = F.col("variant") == 0
    out = rows.groupBy("draft_id").agg(F.max(F.when(v0, F.col("edge"))).alias("a"),
                                       F.max(F.when(~v0, F.col("edge"))).alias("b"))
    return round_doubles(out.select("draft_id", F.col("a").alias("edge_with_teams"),
                                    F.col("b").alias("edge_without_teams"), (F.col("a") - F.col("b")).alias("delta")))


@register("winner_struct", with_ctes(*MATCHES_CTES, *_SCORED, select="""
SELECT gameid, CASE WHEN p > 0.5 THEN 'Blue' ELSE 'Red' END AS winner, round(greatest(p, 1 - p), 6) AS confidence,
       p AS p_blue, round(1 - p, 6) AS p_red FROM sc0"""))
def q_winner_struct(spark, sf):
    """B2 on a fixed score: winner, confidence and both probabilities."""
    f = champ_features(spark, sf)
    p = F.round(F.least(F.greatest(F.lit(0.5) + F.lit(4.0) * (F.col("cb") - F.col("cr")), F.lit(0.0)), F.lit(1.0)), 6)
    return round_doubles(f.select("gameid", S.winner_fields(p).alias("w")).select("gameid", "w.*"))


_THRESHOLDS = [x + 0.5 for x in range(20, 35)]


@register("threshold_map", with_ctes(*MATCHES_CTES, *_SCORED, f"""tp AS (
  SELECT gameid, t, least(greatest(0.5 + 4 * (cb - cr) - (t - 27.5) / 20, 0.0), 1.0) AS p
  FROM sc0 CROSS JOIN (SELECT unnest({_THRESHOLDS}) AS t))""", select="""
SELECT gameid, list('over_' || CAST(t AS VARCHAR) ORDER BY t) AS keys, list(__BR__ ORDER BY t) AS probs
FROM tp GROUP BY gameid""".replace("__BR__", bround_sql("p", 3))))
def q_threshold_map(spark, sf):
    """B5/W11 on a fixed score per kill threshold: map ordered numerically
    (``over_20.5`` ... ``over_34.5``), probabilities to 3 places."""
    f = champ_features(spark, sf)
    d = F.col("cb") - F.col("cr")
    entries = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(S.threshold_key(t)).alias("key"),
                                 F.least(F.greatest(F.lit(0.5) + 4 * d - F.lit((t - 27.5) / 20), F.lit(0.0)),
                                         F.lit(1.0)).alias("p")) for t in _THRESHOLDS])
    m = f.select("gameid", S.threshold_map(entries).alias("m"))
    return m.select("gameid", F.map_keys("m").alias("keys"), F.map_values("m").alias("probs"))


_SEEN = f"""seen AS (
  SELECT DISTINCT {duck_norm('c')} AS champion FROM (
    SELECT unnest(blue_picks || red_picks) AS c FROM matches))"""


def _seen(spark, sf):
    return role_stats_long(base_matches(spark, sf)).select("champion").distinct()


@register("draft_quality", with_ctes(*MATCHES_CTES, _SEEN, DRAFTS_CTE, _VALIDATE, _PREP, f"""pk AS (
  SELECT draft_id, 'blue' AS side, unnest(blue_picks) AS pick FROM prep
  UNION ALL SELECT draft_id, 'red', unnest(red_picks) FROM prep)""", select=f"""
SELECT draft_id, count(e.champion) AS known, count(e.champion) / 10.0 AS known_ratio,
       coalesce(list_sort(list(pick) FILTER (WHERE e.champion IS NULL AND side = 'blue')), []) AS unknown_blue,
       coalesce(list_sort(list(pick) FILTER (WHERE e.champion IS NULL AND side = 'red')), []) AS unknown_red
FROM pk LEFT JOIN seen e ON e.champion = {duck_norm('pick')} GROUP BY draft_id"""))
def q_draft_quality(spark, sf):
    """Share of each valid draft's picks seen in any match, and
    the unseen picks."""
    v = S.prepare_drafts(S.validate_drafts(_drafts(spark, sf)).where("error IS NULL").drop("error"))
    q = S.draft_quality(v, _seen(spark, sf))
    return q.select("draft_id", F.col("known").cast("bigint").alias("known"), "known_ratio",
                    "unknown_blue", "unknown_red")




@register("unknown_picks", with_ctes(*MATCHES_CTES, _SEEN, DRAFTS_CTE, _VALIDATE, _PREP, f"""pk AS (
  SELECT draft_id, 'blue' AS side, unnest(blue_picks) AS pick FROM prep
  UNION ALL SELECT draft_id, 'red', unnest(red_picks) FROM prep)""", select=f"""
SELECT draft_id, side, pick FROM pk
WHERE NOT EXISTS (SELECT 1 FROM seen e WHERE e.champion = {duck_norm('pick')})"""))
def q_unknown_picks(spark, sf):
    """Picks of valid drafts not seen in any match (explode + left anti
    join against the seen set)."""
    v = S.prepare_drafts(S.validate_drafts(_drafts(spark, sf)).where("error IS NULL").drop("error"))
    items = F.concat(F.transform("blue_picks", lambda c: F.struct(F.lit("blue").alias("side"), c.alias("pick"))),
                     F.transform("red_picks", lambda c: F.struct(F.lit("red").alias("side"), c.alias("pick"))))
    p = v.select("draft_id", F.inline(items))
    seen = _seen(spark, sf)
    return p.join(seen, normalize_name(p["pick"]) == seen["champion"], "left_anti").select("draft_id", "side", "pick")


@register("score_requests", _d(_PREP, select="""
SELECT draft_id, blue_picks, red_picks, blue_team, red_team, 1 AS blue_side, 0 AS red_side FROM prep"""))
def q_score_requests(spark, sf):
    """The scoring input built from any DataFrame of drafts: valid
    requests with title-cased picks, default teams and side flags."""
    v = S.validate_drafts(_drafts(spark, sf)).where("error IS NULL").drop("error")
    return S.prepare_drafts(v).select("draft_id", "blue_picks", "red_picks", "blue_team", "red_team",
                                      "blue_side", "red_side")
