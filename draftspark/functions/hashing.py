"""Signed feature hashing (F16).

Contract: ``h`` = the first 32 bits of the token's MD5 as an unsigned number;
bucket = ``h % n``; sign = +1 when ``h div n`` is even, else -1.  The same
``h`` is available in DuckDB, so hashed features are oracle-checkable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_hash(tok) -> Column:
    t = F.col(tok) if isinstance(tok, str) else tok
    return F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint")


def bucket(h: Column, n: int) -> Column:
    return (h % F.lit(n)).cast("int")


def sign(h: Column, n: int) -> Column:
    return F.when(F.floor(h / F.lit(n)) % 2 == 0, F.lit(1)).otherwise(F.lit(-1))


def duck_hash(expr: str) -> str:
    return f"CAST(('0x' || substr(md5({expr}), 1, 8)) AS BIGINT)"
