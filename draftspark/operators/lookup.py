"""Lookups of encoder state.

Encoder state (one row per team, champion or token) is joined to wide match
rows.  No join carries a hint: the tables' sizes, known to the planner or found
at run time, decide between a broadcast and a shuffle.  Closed domains (champions,
role tokens) whose size is checked can travel in the plan instead (``literal_map``),
so that a look-up is a projection; beyond that size callers join.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of a table that may travel inside a plan as a literal map.
MAP_ENTRIES = 4096
_PARTS = 64


def lookup(df: DataFrame, table: DataFrame, left_key: str, right_key: str,
           value_cols: dict[str, str], default=None) -> DataFrame:
    """Left join ``table`` on ``left_key = right_key``; rename value columns
    (``{table_col: out_col}``) and fill misses with ``default``."""
    sel = [F.col(right_key).alias("_lk")] + [F.col(c).alias(o) for c, o in value_cols.items()]
    t = table.select(*sel)
    out = df.join(t, df[left_key].eqNullSafe(t["_lk"]), "left").drop("_lk")
    if default is not None:
        for o in value_cols.values():
            d = default if not isinstance(default, dict) else default[o]
            out = out.withColumn(o, F.coalesce(F.col(o), d if hasattr(d, "_jc") else F.lit(d)))
    return out


def literal_map(table: DataFrame, key: str, value: str, most: int = MAP_ENTRIES):
    """A function (key column -> value column, null if unknown) over a table of
    numbers, or arrays of them, of at most ``most`` rows; None if it has more.  Entries are spread over small
    maps by the hash of the key, as a map is searched from end to end."""
    rows = table.select(F.col(key).alias("k"), F.col(value).alias("v"), F.pmod(F.xxhash64(key), F.lit(_PARTS)).alias("p")).limit(most + 1).collect()
    if len(rows) > most:
        return None
    kind = table.schema[value].dataType.simpleString()
    parts = [{} for _ in range(_PARTS)]
    for r in rows:
        if r["k"] is not None:
            parts[r["p"]][r["k"]] = r["v"]
    maps = F.from_json(F.lit(json.dumps(parts)), f"array<map<string,{kind}>>")  # a constant, folded once
    return lambda k: F.try_element_at(F.get(maps, F.pmod(F.xxhash64(k), F.lit(_PARTS))), k)
