"""Distinct lists, encoder tables and encoded features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import duck_norm, normalize_name
from ..operators import encoders as E
from ..sources.fixture import match_rows, with_ctes
from .common import base_matches, round_doubles
from .q_matches import MATCHES_CTES
from .registry import register


def _m(*ctes, select):
    return with_ctes(*MATCHES_CTES, *ctes, select=select)


# --- A4 / A5 ----------------------------------------------------------------

@register("distinct_leagues", with_ctes(select="SELECT DISTINCT league FROM match_rows WHERE league IS NOT NULL"))
def q_distinct_leagues(spark, sf):
    return match_rows(spark, sf).select("league").where(F.col("league").isNotNull()).distinct()


@register("distinct_champions", with_ctes(select="""
SELECT DISTINCT champion FROM match_rows WHERE NULLIF(champion, '') IS NOT NULL"""))
def q_distinct_champions(spark, sf):
    c = F.nullif(F.col("champion"), F.lit(""))
    return match_rows(spark, sf).select("champion").where(c.isNotNull()).distinct()


@register("distinct_teams", with_ctes(select="SELECT DISTINCT teamname AS team FROM match_rows WHERE teamname IS NOT NULL"))
def q_distinct_teams(spark, sf):
    return (match_rows(spark, sf).select(F.col("teamname").alias("team"))
            .where(F.col("team").isNotNull()).distinct())


_SEEN = f"""seen AS (
  SELECT DISTINCT {duck_norm('c')} AS champion FROM (
    SELECT unnest(blue_picks) AS c FROM matches UNION ALL SELECT unnest(red_picks) FROM matches))"""


@register("seen_champions", _m(_SEEN, select="SELECT champion FROM seen"))
def q_seen_champions(spark, sf):
    m = base_matches(spark, sf)
    return (m.select(F.explode(F.concat("blue_picks", "red_picks")).alias("c"))
            .select(normalize_name("c").alias("champion")).distinct())


# --- U1 / A7 / V4 -----------------------------------------------------------

@register("team_appearances", _m(select="""
SELECT blue_team AS team, CAST(result AS DOUBLE) AS y FROM matches
UNION ALL SELECT red_team, 1.0 - result FROM matches"""))
def q_team_appearances(spark, sf):
    return E.team_appearances(base_matches(spark, sf), "result", invert_red=True)


def _sigmoid_sql(app_sql: str, s: float, k: float = 20.0) -> list[str]:
    return [f"app AS ({app_sql})",
            "pr AS (SELECT avg(y) AS prior FROM app)",
            f"""st AS (
  SELECT team, count(*) AS n, avg(y) AS mean,
         1.0 / (1.0 + exp(-(count(*) - {k}) / {s})) AS lam FROM app GROUP BY team)""",
            "enc AS (SELECT team, n, mean, prior * (1 - lam) + mean * lam AS enc FROM st, pr)"]


_WIN_APP = ("SELECT blue_team AS team, CAST(result AS DOUBLE) AS y FROM matches "
            "UNION ALL SELECT red_team, 1.0 - result FROM matches")


@register("team_strength_table", _m(*_sigmoid_sql(_WIN_APP, 15.0), select="""
SELECT team, n, round(mean, 6) AS mean, round(enc, 6) AS enc FROM enc"""))
def q_team_strength_table(spark, sf):
    app = E.team_appearances(base_matches(spark, sf), "result", invert_red=True)
    table, _ = E.sigmoid_target_table(app, 15.0, 20.0)
    return round_doubles(table)


def _encoded_sql(a: str, b: str) -> str:
    return f"""
SELECT m.gameid, round(coalesce(eb.enc, pr.prior), 6) AS {a}, round(coalesce(er.enc, pr.prior), 6) AS {b}
FROM matches m CROSS JOIN pr
LEFT JOIN enc eb ON eb.team IS NOT DISTINCT FROM m.blue_team
LEFT JOIN enc er ON er.team IS NOT DISTINCT FROM m.red_team"""


@register("team_strength", _m(*_sigmoid_sql(_WIN_APP, 15.0),
                              select=_encoded_sql("blue_team_strength", "red_team_strength")))
def q_team_strength(spark, sf):
    m = base_matches(spark, sf, reuse=True)
    model = E.TeamStrengthEncoder(smoothing=15.0, labelCol="result").fit(m)
    return round_doubles(model.transform(m).select("gameid", "blue_team_strength", "red_team_strength"))


# --- A8 / V11: same y for both sides (game minutes, smoothing 20) -----------

_MIN_APP = ("SELECT blue_team AS team, gamelength / 60.0 AS y FROM matches "
            "UNION ALL SELECT red_team, gamelength / 60.0 FROM matches")


@register("team_target_mean", _m(*_sigmoid_sql(_MIN_APP, 20.0),
                                 select=_encoded_sql("blue_team_enc", "red_team_enc")))
def q_team_target_mean(spark, sf):
    m = base_matches(spark, sf, reuse=True).withColumn("minutes", F.col("gamelength") / 60.0)
    model = E.TeamStrengthEncoder(smoothing=20.0, labelCol="minutes", invertRed=False).fit(m)
    out = model.transform(m).select("gameid", F.col("blue_team_strength").alias("blue_team_enc"),
                                    F.col("red_team_strength").alias("red_team_enc"))
    return round_doubles(out)


@register("residual_std", _m(*_sigmoid_sql(_MIN_APP, 20.0), f"""pred AS ({_encoded_sql('b', 'r')})""", select="""
SELECT round(stddev_pop(m.gamelength / 60.0 - (p.b + p.r) / 2), 6) AS residual_std,
       count(*) AS n FROM matches m JOIN pred p ON p.gameid = m.gameid"""))
def q_residual_std(spark, sf):
    """Population std of minutes minus the mean of both team encodings."""
    m = base_matches(spark, sf, reuse=True).withColumn("minutes", F.col("gamelength") / 60.0)
    model = E.TeamStrengthEncoder(smoothing=20.0, labelCol="minutes", invertRed=False).fit(m)
    # round the encodings as the oracle does before differencing
    p = round_doubles(model.transform(m).select("gameid", "minutes", "blue_team_strength", "red_team_strength"))
    res = F.col("minutes") - (F.col("blue_team_strength") + F.col("red_team_strength")) / 2
    return round_doubles(p.agg(F.stddev_pop(res).alias("residual_std"), F.count(F.lit(1)).alias("n")))


# --- A9 / V10: unsmoothed per-side mean of an over-25.5-kills label ----------

_OVER = "CASE WHEN total_kills > 25.5 THEN 1 ELSE 0 END"


@register("team_side_mean_table", _m(select=f"""
SELECT 'blue' AS side, blue_team AS team, round(avg({_OVER}), 6) AS mean FROM matches GROUP BY blue_team
UNION ALL
SELECT 'red', red_team, round(avg({_OVER}), 6) FROM matches GROUP BY red_team"""))
def q_team_side_mean_table(spark, sf):
    m = base_matches(spark, sf).withColumn("over", (F.col("total_kills") > 25.5).cast("int"))
    blue, red = E.team_side_mean_tables(m, "over")
    return round_doubles(blue.select(F.lit("blue").alias("side"), "team", "mean")
                         .unionByName(red.select(F.lit("red").alias("side"), "team", "mean")))


@register("team_side_mean", _m(f"""b AS (SELECT blue_team AS team, avg({_OVER}) AS mean FROM matches GROUP BY 1)""",
                               f"""rr AS (SELECT red_team AS team, avg({_OVER}) AS mean FROM matches GROUP BY 1)""",
                               select="""
SELECT m.gameid, round(coalesce(b.mean, 0.5), 6) AS blue_team_enc, round(coalesce(rr.mean, 0.5), 6) AS red_team_enc
FROM matches m LEFT JOIN b ON b.team = m.blue_team LEFT JOIN rr ON rr.team = m.red_team"""))
def q_team_side_mean(spark, sf):
    m = base_matches(spark, sf, reuse=True).withColumn("over", (F.col("total_kills") > 25.5).cast("int"))
    model = E.TeamTargetEncoder(labelCol="over").fit(m)
    return round_doubles(model.transform(m).select("gameid", "blue_team_enc", "red_team_enc"))


# --- A10 / V8 ------------------------------------------------------------------

_CHAMP = [f"""cp AS (
  SELECT {duck_norm('c')} AS champion, win FROM (
    SELECT unnest(blue_picks) AS c, result AS win FROM matches
    UNION ALL SELECT unnest(red_picks), 1 - result FROM matches))""",
          "cs AS (SELECT champion, CAST(sum(win) AS BIGINT) AS wins, count(*) AS games FROM cp GROUP BY champion)",
          "gl AS (SELECT CAST(sum(wins) AS DOUBLE) / sum(games) AS g FROM cs)",
          "cw AS (SELECT champion, wins, games, (wins + 10 * g) / (games + 10) AS win_rate FROM cs, gl)"]


@register("champ_wr_table", _m(*_CHAMP, select="SELECT champion, wins, games, round(win_rate, 6) AS win_rate FROM cw"))
def q_champ_wr_table(spark, sf):
    table, _ = E.champion_win_rate_table(base_matches(spark, sf), 10.0)
    return round_doubles(table)


_CHAMP_FEATURES = [*_CHAMP, f"""sc AS (
  SELECT gameid, sum(CASE WHEN is_blue = 1 THEN coalesce(cw.win_rate, gl.g) ELSE 0 END) AS b,
         sum(CASE WHEN is_blue = 0 THEN coalesce(cw.win_rate, gl.g) ELSE 0 END) AS r
  FROM (SELECT gameid, {duck_norm('c')} AS champion, is_blue FROM (
          SELECT gameid, unnest(blue_picks) AS c, 1 AS is_blue FROM matches
          UNION ALL SELECT gameid, unnest(red_picks), 0 FROM matches)) x
  CROSS JOIN gl LEFT JOIN cw USING (champion)
  GROUP BY gameid)""", """cf AS (
  SELECT m.*, coalesce(sc.b, 0) / 5.0 AS blue_champ_wr, coalesce(sc.r, 0) / 5.0 AS red_champ_wr
  FROM matches m LEFT JOIN sc USING (gameid))"""]


@register("champ_wr_features", _m(*_CHAMP_FEATURES, select="""
SELECT gameid, round(blue_champ_wr, 6) AS blue_champ_wr, round(red_champ_wr, 6) AS red_champ_wr FROM cf"""))
def q_champ_wr_features(spark, sf):
    m = base_matches(spark, sf, reuse=True)
    model = E.ChampionWinRateEstimator(smoothing=10.0).fit(m)
    return round_doubles(model.transform(m).select("gameid", "blue_champ_wr", "red_champ_wr"))


# --- A11 / V9 ------------------------------------------------------------------

_SIDE = ["gm AS (SELECT avg(result) AS g FROM matches)",
         """sb AS (SELECT blue_team AS team, count(*) AS games, CAST(sum(result) AS BIGINT) AS wins
                   FROM matches GROUP BY blue_team)""",
         """sr AS (SELECT red_team AS team, count(*) AS games, CAST(sum(1 - result) AS BIGINT) AS wins
                   FROM matches GROUP BY red_team)"""]


@register("team_side_wr_table", _m(*_SIDE, select="""
SELECT 'blue' AS side, team, games, wins, round((wins + 10 * g) / (games + 10), 6) AS rate FROM sb, gm
UNION ALL
SELECT 'red', team, games, wins, round((wins + 10 * (1 - g)) / (games + 10), 6) FROM sr, gm"""))
def q_team_side_wr_table(spark, sf):
    blue, red, _ = E.team_side_win_rate_tables(base_matches(spark, sf), 10.0)
    cols = ["side", "team", "games", "wins", "rate"]
    return round_doubles(blue.withColumn("side", F.lit("blue")).select(cols)
                         .unionByName(red.withColumn("side", F.lit("red")).select(cols)))


@register("team_side_wr", _m(*_SIDE, select="""
SELECT m.gameid,
       round(coalesce((sb.wins + 10 * gm.g) / (sb.games + 10), gm.g), 6) AS blue_side_wr,
       round(coalesce((sr.wins + 10 * (1 - gm.g)) / (sr.games + 10), 1 - gm.g), 6) AS red_side_wr
FROM matches m CROSS JOIN gm LEFT JOIN sb ON sb.team = m.blue_team LEFT JOIN sr ON sr.team = m.red_team"""))
def q_team_side_wr(spark, sf):
    m = base_matches(spark, sf, reuse=True)
    model = E.TeamSideWinRateEstimator(smoothing=10.0).fit(m)
    return round_doubles(model.transform(m).select("gameid", "blue_side_wr", "red_side_wr"))


# --- A12 -----------------------------------------------------------------------

@register("target_stats", _m(select="""
SELECT round(avg(total_kills), 6) AS mean, round(stddev_samp(total_kills), 6) AS std,
       min(total_kills) AS min, max(total_kills) AS max, count(*) AS n FROM matches"""))
def q_target_stats(spark, sf):
    m = base_matches(spark, sf)
    return round_doubles(m.agg(F.avg("total_kills").alias("mean"), F.stddev_samp("total_kills").alias("std"),
                               F.min("total_kills").alias("min"), F.max("total_kills").alias("max"),
                               F.count(F.lit(1)).alias("n")))


# --- V13 -----------------------------------------------------------------------

@register("zscore", _m(*_CHAMP_FEATURES, select="""
SELECT gameid,
       round((blue_champ_wr - avg(blue_champ_wr) OVER ()) / stddev_samp(blue_champ_wr) OVER (), 6) AS z_blue,
       round((red_champ_wr - avg(red_champ_wr) OVER ()) / stddev_samp(red_champ_wr) OVER (), 6) AS z_red
FROM cf"""))
def q_zscore(spark, sf):
    """StandardScaler (mean and n-1 std) over the champion win-rate features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    m = base_matches(spark, sf, reuse=True)
    pipe = Pipeline(stages=[E.ChampionWinRateEstimator(smoothing=10.0),
                            VectorAssembler(inputCols=["blue_champ_wr", "red_champ_wr"], outputCol="x"),
                            StandardScaler(inputCol="x", outputCol="z", withMean=True, withStd=True)])
    out = pipe.fit(m).transform(m).select("gameid", vector_to_array("z").alias("z"))
    return round_doubles(out.select("gameid", F.col("z")[0].alias("z_blue"), F.col("z")[1].alias("z_red")))
