import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from draftspark.session import DEFAULT_CONF

    b = SparkSession.builder.master("local[4]").appName("draftspark-tests")
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", "4")
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="draftspark-test-ckpt-"))
    yield s


def rows_df(spark, rows):
    """Participant rows: (gameid, side, participantid, champion, teamname,
    result, kills, gamelength, towers, date)."""
    import datetime as dt

    data = [(g, dt.datetime(2024, 1, 1) + dt.timedelta(days=d), "L1", s, str(p), c, t, r, k, gl, tw)
            for g, s, p, c, t, r, k, gl, tw, d in rows]
    return spark.createDataFrame(
        data, "gameid string, date timestamp, league string, side string, participantid string, champion string, "
              "teamname string, result int, kills int, gamelength int, towers int")


def game(gid, blue, red, bt="A", rt="B", result=1, day=0, kills=1, gl=1800, team_rows=True):
    """Rows of one game: players numbered 1..n in order, blue first."""
    out = []
    pn = 1
    for c in blue:
        out.append((gid, "Blue", pn, c, bt, result, kills, gl, None, day))
        pn += 1
    for c in red:
        out.append((gid, "Red", pn, c, rt, 1 - result, kills, gl, None, day))
        pn += 1
    if team_rows:
        out.append((gid, "Blue", 100, "", bt, result, kills * len(blue), gl, 5, day))
        out.append((gid, "Red", 200, "", rt, 1 - result, kills * len(red), gl, 4, day))
    return out
