"""Source queries: typed CSV scan, NA tokens, inferred scan, freshness.

The participant rows are written by Spark as CSV into the shared scratch
folder and read back through the engine's loaders, so the scans run on the
whole fixture.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.participants import coerce_numeric
from ..session import scratch_path
from ..sources import files as S
from ..sources.fixture import TOWERS_TEXT_CTE, match_rows, towers_text, with_ctes
from .registry import register


def _csv(spark, sf, df, name):
    return S.write_csv(df, scratch_path(spark, name))


@register("scan_typed", with_ctes(select="""
SELECT gameid, side, champion, teamname, CAST(result AS TINYINT) AS result, date, participantid,
       CAST(kills AS FLOAT) AS kills, CAST(gamelength AS FLOAT) AS gamelength
FROM match_rows"""))
def q_scan_typed(spark, sf):
    """Declared-type scan pruned to the nine loader columns; blank text kept as ''."""
    path = _csv(spark, sf, match_rows(spark, sf), "participants-csv")
    return S.read_participants(spark, path)


@register("scan_na_tokens", with_ctes(TOWERS_TEXT_CTE, select="""
SELECT gameid, participantid, CASE WHEN towers IS NULL OR trim(towers) = '' THEN NULL ELSE towers END AS towers,
       CAST(TRY_CAST(trim(towers) AS DOUBLE) AS INT) AS towers_num
FROM towers_text"""))
def q_scan_na_tokens(spark, sf):
    """S3/P7: '' and ' ' read as null; other junk ('n/a') stays text and
    parses to a null number."""
    path = _csv(spark, sf, towers_text(match_rows(spark, sf)), "towers-csv")
    df = S.read_with_na_tokens(spark, path, "gameid string, participantid string, side string, towers string",
                               ["towers"], ("", " "))
    return df.select("gameid", "participantid", "towers", coerce_numeric("towers").alias("towers_num"))


@register("scan_inferred", with_ctes(select="""
SELECT CAST(gameid AS INT) AS gameid, date, league, side, CAST(participantid AS INT) AS participantid,
       nullif(champion, '') AS champion, teamname, result, kills, gamelength, towers
FROM match_rows"""))
def q_scan_inferred(spark, sf):
    """Full scan with inferred column types."""
    path = _csv(spark, sf, match_rows(spark, sf), "participants-csv-inferred")
    return S.read_inferred(spark, path)


@register("source_freshness")
def q_source_freshness(spark, sf):
    """Newest modification time of the participant files, formatted."""
    path = _csv(spark, sf, match_rows(spark, sf), "participants-csv-fresh")
    return S.freshness(spark, path)


@register("union_seasons", with_ctes(select="""
SELECT gameid, participantid, champion, CASE WHEN year(date) <= 1995 THEN towers END AS towers,
       CASE WHEN year(date) <= 1995 THEN 'early' ELSE 'late' END AS season
FROM match_rows"""))
def q_union_seasons(spark, sf):
    """Two season folders with different columns (the later one has no
    towers) read separately and stacked by name, missing columns as null."""
    rows = match_rows(spark, sf).withColumn("season", F.when(F.year("date") <= 1995, "early").otherwise("late"))
    early, late = scratch_path(spark, "season-early"), scratch_path(spark, "season-late")
    rows.where("season = 'early'").write.mode("overwrite").parquet(early)
    rows.where("season = 'late'").drop("towers").write.mode("overwrite").parquet(late)
    both = spark.read.parquet(early).unionByName(spark.read.parquet(late), allowMissingColumns=True)
    return both.select("gameid", "participantid", "champion", "towers", "season")
