"""Role statistics and role assignment.

Role assignment picks, for each team of five, the permutation of picks over
the roles ``top, jng, mid, bot, sup`` with the highest total historical play
count; of equal totals the first permutation in lexicographic order of pick
positions wins (all-zero scores keep the input order).  A team that does not have
exactly five picks is returned unchanged.

Plan: the best total of a set of picks in the first roles is the best, over its
last pick, of the total without that pick plus its count in the role: 31 sets
instead of 120 permutations.  A total carries its permutation in the low digits, so
the greatest number is the best total and, of equal ones, the first permutation.
The counts come from a literal map (a champion is one of a closed domain, and its
size is checked) and the order from a function of them in the JVM (``Places.java``),
so the whole assignment is a projection; a larger table is joined to the exploded
picks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, MapType, StringType

from ..functions.names import ROLES, normalize_name
from ..jvm import call
from .lookup import literal_map, lookup

N = len(ROLES)


def role_stats_long(matches: DataFrame) -> DataFrame:
    """(champion, role, games) over reconstructed matches; the role is
    the pick's position inside its side (1..5 -> top..sup)."""
    roles = F.array(*[F.lit(r) for r in ROLES])

    def tag(col):
        return F.transform(F.slice(col, 1, 5), lambda c, i: F.struct(
            normalize_name(c).alias("champion"), roles[i].alias("role")))

    picks = matches.select(F.inline(F.concat(tag(F.col("blue_picks")), tag(F.col("red_picks")))))
    return picks.groupBy("champion", "role").agg(F.count(F.lit(1)).alias("games"))


def role_stats_nested(long: DataFrame) -> DataFrame:
    """Nested form ``champion -> {role: games}`` (one row per champion)."""
    return long.groupBy("champion").agg(
        F.map_from_entries(F.collect_list(F.struct("role", "games"))).alias("roles"))


NESTED_SCHEMA = MapType(StringType(), MapType(StringType(), LongType()))


def read_role_stats_json(spark, path: str, multi_line: bool = False) -> DataFrame:
    """Read JSON documents ``{champion: {role: games}}`` and explode them
    twice to the long form.  One document per line by default; with
    ``multi_line`` each file is one (pretty-printed) document."""
    doc = spark.read.text(path, wholetext=multi_line)
    m = doc.select(F.explode(F.from_json("value", NESTED_SCHEMA)).alias("champion", "roles"))
    return m.select("champion", F.explode("roles").alias("role", "games"))


def write_role_stats_json(long: DataFrame, path: str) -> None:
    """Write the nested form for ``read_role_stats_json``: JSON lines, one
    object per champion."""
    doc = role_stats_nested(long).select(F.to_json(F.create_map("champion", "roles")).alias("value"))
    doc.write.mode("overwrite").text(path)


def _stats_wide(stats_long: DataFrame) -> DataFrame:
    """(champion, scores[5]) in role order; small (one row per champion)."""
    return stats_long.groupBy("champion").agg(F.array(*[
        F.coalesce(F.sum(F.when(F.col("role") == r, F.col("games"))), F.lit(0)).cast("bigint")
        for r in ROLES]).alias("scores"))


def best_order(df: DataFrame, scores: str, out: str) -> DataFrame:
    """Add ``out``: the places of the picks in role order, for the column
    ``scores`` (pick x role counts, bigint)."""
    return df.withColumn(out, call("Places", ArrayType(IntegerType()), F.col(scores)))


def _in_order(picks: Column, places: Column) -> Column:
    return F.when(F.size(picks) == N, F.transform(places, lambda i: F.get(picks, i))).otherwise(picks)


def assign_roles(df: DataFrame, stats_long: DataFrame, id_col: str = "gameid", cols=("blue_picks", "red_picks"),
                 suffix: str = "_sorted") -> DataFrame:
    """V1: add ``<col><suffix>`` with each team's picks in role order."""
    wide = _stats_wide(stats_long)
    known = literal_map(wide, "champion", "scores")
    if known is None:
        return _assign_by_join(df, wide, id_col, cols, suffix)
    for c in cols:
        df = df.withColumn("_scores", F.transform(c, lambda x: known(normalize_name(x))))
        df = best_order(df, "_scores", "_places").withColumn(f"{c}{suffix}", _in_order(F.col(c), F.col("_places"))).drop("_scores", "_places")
    return df


def _assign_by_join(df: DataFrame, wide: DataFrame, id_col: str, cols, suffix: str) -> DataFrame:
    """The same with the counts joined to one row per pick and regrouped."""
    def tag(t, c):
        return F.transform(c, lambda x, i: F.struct(F.lit(t).alias("team"), i.alias("pos"), x.alias("champ")))

    items = F.concat(*[tag(t, c) for t, c in enumerate(cols)])
    longf = df.select(id_col, F.inline(items)).withColumn("norm", normalize_name("champ"))
    looked = lookup(longf, wide, "norm", "champion", {"scores": "scores"})
    teams = looked.groupBy(id_col, "team").agg(F.array_sort(F.collect_list(F.struct("pos", "champ", "scores"))).alias("p"))
    teams = best_order(teams.withColumn("_scores", F.col("p.scores")), "_scores", "_places")
    teams = teams.select(id_col, "team", _in_order(F.col("p.champ"), F.col("_places")).alias("s"))
    wide_out = teams.groupBy(id_col).agg(*[
        F.max(F.when(F.col("team") == t, F.col("s"))).alias(f"{c}{suffix}") for t, c in enumerate(cols)])
    out = df.join(wide_out, id_col, "left")
    for c in cols:  # empty pick lists have no exploded rows
        out = out.withColumn(f"{c}{suffix}", F.coalesce(F.col(f"{c}{suffix}"), F.col(c)))
    return out
