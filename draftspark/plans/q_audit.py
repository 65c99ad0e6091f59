"""Name audits, searches and scalar functions over names and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import ALIASES, KNOWN_PROBLEM_NAMES, duck_norm, normalize_name
from ..operators import audit as A
from ..sources.fixture import NAMES_CTE, match_rows, names, table, with_ctes
from .registry import register


def _names(spark, sf):
    return names(match_rows(spark, sf))


@register("normalize_name", with_ctes(NAMES_CTE, select=f"SELECT name, {duck_norm('name')} AS normalized FROM names"))
def q_normalize_name(spark, sf):
    """``strip().title()`` semantics (a capital after every non-letter)."""
    return _names(spark, sf).select("name", normalize_name("name").alias("normalized"))


@register("name_audit", with_ctes(NAMES_CTE, select=f"""
SELECT name, {duck_norm('name')} AS titled, name <> {duck_norm('name')} AS changed,
       contains(name, '''') AS has_apostrophe FROM names WHERE name IS NOT NULL"""))
def q_name_audit(spark, sf):
    return A.name_audit(_names(spark, sf))


_KNOWN = ", ".join("('" + n.replace("'", "''") + "')" for n in KNOWN_PROBLEM_NAMES)


@register("name_presence", with_ctes(NAMES_CTE, f"k AS (SELECT * FROM (VALUES {_KNOWN}) t(name))", select=f"""
SELECT k.name, EXISTS (SELECT 1 FROM names n WHERE n.name = k.name) AS present,
       {duck_norm('k.name')} AS titled, {duck_norm('k.name')} = k.name AS titled_equal FROM k"""))
def q_name_presence(spark, sf):
    """D3: the known problem names tested for exact presence among the data's
    names, with their title-cased form and whether it equals the name."""
    n = _names(spark, sf)
    return A.name_presence(n)


@register("champion_search", with_ctes(NAMES_CTE, select="""
SELECT name FROM names WHERE contains(regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), 'redg')"""))
def q_champion_search(spark, sf):
    """'Red G' -> key 'redg' matches 'red gear', 'RED GIZMO', "red'gear"."""
    return A.champion_search(_names(spark, sf), "Red G")


@register("substring_search", with_ctes(NAMES_CTE, select="""
SELECT name FROM names WHERE contains(lower(name), 'gizmo')"""))
def q_substring_search(spark, sf):
    return A.substring_search(_names(spark, sf), "GIZMO")


_ALIAS_VALUES = ", ".join("('" + k.replace("'", "''") + "', '" + v + "')" for k, v in ALIASES.items())


@register("canonical_id", with_ctes(NAMES_CTE, f"al AS (SELECT * FROM (VALUES {_ALIAS_VALUES}) t(alias_name, alias_id))",
                                    select="""
SELECT n.name, coalesce(al.alias_id, regexp_replace(n.name, '['' .]', '', 'g')) AS canonical_id
FROM names n LEFT JOIN al ON al.alias_name = n.name"""))
def q_canonical_id(spark, sf):
    return A.canonical_id(_names(spark, sf)).select("name", "canonical_id")


@register("json_props", with_ctes(select="""
SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), 0) AS k,
       json_extract_string(props, '$.missing') IS NULL AS missing_is_null
FROM events"""))
def q_json_props(spark, sf):
    """nested JSON access with a default."""
    ev = table(spark, sf, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0))
    return ev.select("event_id", k.alias("k"), F.get_json_object("props", "$.missing").isNull().alias("missing_is_null"))


@register("event_clock", with_ctes("""ev AS (
  SELECT event_id, user_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events)""", """p AS (
  SELECT event_id, user_id, CAST(strptime(iso, '%Y-%m-%dT%H:%M:%SZ') AS TIMESTAMP) AS t FROM ev)""", """f AS (
  SELECT user_id, min(t) AS first_t FROM p GROUP BY user_id)""", select="""
SELECT p.event_id, strftime(p.t, '%H:%M:%S') AS clock,
       CAST(epoch(p.t) - epoch(f.first_t) AS BIGINT) AS seconds_since_first
FROM p JOIN f USING (user_id)"""))
def q_event_clock(spark, sf):
    """ISO-8601 text with ``Z`` parsed back to a timestamp, formatted as
    ``HH:mm:ss``, and seconds since the game's first frame (aggregate +
    join, no window on the game key)."""
    ev = table(spark, sf, "events")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    p = ev.select("event_id", "user_id", F.to_timestamp(iso, "yyyy-MM-dd'T'HH:mm:ssX").alias("t"))
    first = p.groupBy("user_id").agg(F.min("t").alias("first_t"))
    out = p.join(first, "user_id")
    return out.select("event_id", F.date_format("t", "HH:mm:ss").alias("clock"),
                      (F.unix_timestamp("t") - F.unix_timestamp("first_t")).alias("seconds_since_first"))
