"""Helpers shared by the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..operators.matches import matches
from ..sources.fixture import match_rows


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round derived doubles for exact comparison with the oracle (the
    oracle SQL rounds the same columns to the same places)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, DoubleType | FloatType):
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def base_matches(spark, sf, reuse: bool = False) -> DataFrame:
    """A1 over the fixture rows (the usual input of features and models).
    ``reuse``: the caller scans it more than once (fit, then transform), so
    it is materialized once in the shared checkpoint folder."""
    m = matches(match_rows(spark, sf))
    return m.checkpoint(eager=True) if reuse else m
