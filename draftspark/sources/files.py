"""File sources and sinks.

Participant CSVs are read with a declared schema (no inference pass over a
large file), so Catalyst prunes the columns a query does not use.  Blank
handling is one explicit choice per loader: ``blanks='keep'`` (blank text
stays ``''``, like the reference's ``na_filter=False`` loaders) or
``blanks='null'``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Declared schema of the participant columns the loaders use.
PARTICIPANT_SCHEMA = ("gameid string, date timestamp, league string, side string, participantid string, "
                      "champion string, teamname string, result tinyint, kills float, gamelength float, "
                      "towers string")

LOADER_COLUMNS = ["gameid", "side", "champion", "teamname", "result", "date", "participantid", "kills",
                  "gamelength"]

# A null marker that never occurs in the data: with it, blanks stay ''.
_NO_NULL_TOKEN = "\u0000"


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with header; leading/trailing spaces are kept (Spark's writer
    trims them by default)."""
    (df.write.mode("overwrite").option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def read_participants(spark: SparkSession, path: str, columns=LOADER_COLUMNS, blanks: str = "keep",
                      schema: str = PARTICIPANT_SCHEMA) -> DataFrame:
    """Typed scan of participant rows, pruned to ``columns``."""
    r = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
    if blanks == "keep":
        r = r.option("nullValue", _NO_NULL_TOKEN)
    return r.csv(path).select(*columns)


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """Every column with inferred types (one extra pass over the file)."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def read_with_na_tokens(spark: SparkSession, path: str, schema: str, columns: list[str],
                        tokens=("", " ")) -> DataFrame:
    """S3: the listed text columns turn null when they equal an NA token
    (a token of spaces matches any all-space cell)."""
    df = spark.read.schema(schema).option("header", True).option("nullValue", _NO_NULL_TOKEN).csv(path)
    space_token = any(t != "" and t.strip() == "" for t in tokens)
    for c in columns:
        v = F.col(c)
        hit = v.isin(*tokens)
        if space_token:
            hit = hit | (F.regexp_replace(v, r"^\s+$", "") == "")
        df = df.withColumn(c, F.when(hit | v.isNull(), F.lit(None).cast("string")).otherwise(v))
    return df


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_or_empty(spark: SparkSession, path: str, schema: str | StructType, reader=None) -> DataFrame:
    """A missing source gives an empty frame of the schema, not a failure."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return reader(path) if reader else spark.read.schema(schema).option("header", True).csv(path)


def freshness(spark: SparkSession, path: str) -> DataFrame:
    """Newest source-file modification time, formatted like
    ``March 04, 2026 at 09:15 PM``.  The files are listed, their content is
    not read."""
    files = spark.read.format("binaryFile").load(path)
    t = files.agg(F.max("modificationTime").alias("modified"))
    return t.select("modified", F.date_format("modified", "MMMM dd, yyyy 'at' hh:mm a").alias("label"))


def write_report(lines: DataFrame, path: str, col: str = "line") -> str:
    """A text report, one line per row (partitioned text files)."""
    lines.select(F.col(col).cast("string")).write.mode("overwrite").text(path)
    return path
