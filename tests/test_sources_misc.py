"""Library functions that are not registered queries: missing source (S6),
text report sink (S12), parameter grids (J14), freshness label (S7)."""

import os
import tempfile

from draftspark.models.grids import REFERENCE_GRIDS, growth_of, points
from draftspark.sources import files as S


def test_missing_source_gives_empty_frame(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="ds-missing-"), "nope.csv")
    df = S.read_or_empty(spark, path, "gameid string, kills int")
    assert df.count() == 0 and df.columns == ["gameid", "kills"]


def test_text_report_sink(spark):
    lines = spark.createDataFrame([("a",), ("b",)], "line string")
    path = S.write_report(lines, os.path.join(tempfile.mkdtemp(prefix="ds-report-"), "r"))
    assert sorted(r.value for r in spark.read.text(path).collect()) == ["a", "b"]


def test_typed_scan_keeps_blanks_and_spaces(spark):
    rows = spark.createDataFrame([("1", " Kai'Sa ", ""), ("2", "", "T")], "gameid string, champion string, teamname string")
    path = S.write_csv(rows, os.path.join(tempfile.mkdtemp(prefix="ds-csv-"), "p"))
    got = {r.gameid: (r.champion, r.teamname) for r in
           S.read_participants(spark, path, columns=["gameid", "champion", "teamname"],
                               schema="gameid string, champion string, teamname string").collect()}
    assert got == {"1": (" Kai'Sa ", ""), "2": ("", "T")}
    f = S.freshness(spark, path).first()
    assert f.modified is not None and " at " in f.label


def test_grid_mapping_and_product():
    g = growth_of({"n_estimators": 100, "learning_rate": 0.05, "num_leaves": 31, "max_depth": -1}, "logistic")
    assert (g.rounds, g.rate, g.leaves, g.depth, g.l1, g.column_share) == (100, 0.05, 31, -1, 0.0, 1.0)
    assert growth_of({"max_depth": 10, "reg_alpha": 0.1, "colsample_bytree": 0.8}, "squared").l1 == 0.1
    grid = points(REFERENCE_GRIDS["kills"])
    assert len(grid) == 8 and grid[0] == {"n_estimators": 100, "learning_rate": 0.05, "num_leaves": 31}
    assert [p["num_leaves"] for p in grid[:2]] == [31, 40]  # the last key varies fastest


def test_participant_rows_take_one_exchange_of_the_line_items(spark):
    """Null keys, repeated parts and suppliers, unknown parts; the rows are those of the oracle's text."""
    import datetime as dt

    from draftspark.sources import fixture as X

    d = dt.date(1995, 1, 1)
    items = [(o if o % 11 else None, n if n != 4 else None, (o * 7 + n) % 9 if (o + n) % 13 else None, (o + n) % 5 if o % 7 else None,
              float(n * 10 + o), d + dt.timedelta(days=o % 5) if n != 2 else None, float(n + o % 6), 0.1, 0.2) for o in range(40) for n in range(1, 6)]
    spark.createDataFrame([*items, *items[:60]], "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_extendedprice double, l_shipdate date, "
                          "l_quantity double, l_discount double, l_tax double").createOrReplaceTempView("lineitem")
    spark.createDataFrame([(k % 7, f"part {k}") for k in range(10)] + [(None, "none"), (8, None)], "p_partkey bigint, p_name string").createOrReplaceTempView("part")
    spark.createDataFrame([(k % 4, f"team {k}", k % 3) for k in range(5)], "s_suppkey bigint, s_name string, s_nationkey bigint").createOrReplaceTempView("supplier")
    spark.createDataFrame([(k, f"N{k}") for k in range(2)], "n_nationkey bigint, n_name string").createOrReplaceTempView("nation")
    ours, stated = spark.sql(X.MATCH_ROWS_SPARK_SQL), spark.sql(X.MATCH_ROWS_SQL)
    assert ours.schema.simpleString() == stated.schema.simpleString()
    rows = sorted(map(str, ours.collect()))
    assert len(rows) > 100 and rows == sorted(map(str, stated.collect()))

    def sources(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("l_orderkey#")

    assert sources(ours) * 2 < sources(stated)
