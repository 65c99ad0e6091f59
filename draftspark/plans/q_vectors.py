"""Vocabulary, signed one-hot and hashed encoders in long form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import bucket, duck_hash, sign, token_hash
from ..functions.names import duck_norm, normalize_name
from ..operators import vectors as V
from ..sources.fixture import with_ctes
from .common import base_matches
from .q_matches import MATCHES_CTES
from .q_roles import ROLE_ASSIGN_CTES, sorted_matches
from .registry import register

_ROLE_LIST = "['top', 'jng', 'mid', 'bot', 'sup']"


def _m(*ctes, select):
    return with_ctes(*MATCHES_CTES, *ctes, select=select)


_SEEN = f"""seen AS (
  SELECT DISTINCT {duck_norm('c')} AS champion FROM (
    SELECT unnest(blue_picks) AS c FROM matches UNION ALL SELECT unnest(red_picks) FROM matches))"""
_VOCAB_ROLE = f"""vocab AS (
  SELECT token, row_number() OVER (ORDER BY token) - 1 AS index FROM (
    SELECT unnest(list_transform({_ROLE_LIST}, lambda r: r || '_' || champion)) AS token FROM seen))"""
_VOCAB_PLAIN = """vocab AS (SELECT champion AS token, row_number() OVER (ORDER BY champion) - 1 AS index FROM seen)"""


@register("vocabulary", _m(_SEEN, _VOCAB_ROLE, select="SELECT token, index FROM vocab"))
def q_vocabulary(spark, sf):
    return V.vocabulary(base_matches(spark, sf), role_aware=True)


@register("vocabulary_plain", _m(_SEEN, _VOCAB_PLAIN, select="SELECT token, index FROM vocab"))
def q_vocabulary_plain(spark, sf):
    return V.vocabulary(base_matches(spark, sf), role_aware=False)


def _onehot_sql(tok_b: str, tok_r: str, src: str) -> str:
    return f"""oh AS (
  SELECT gameid, index, CAST(sum(sgn) AS DOUBLE) AS value FROM (
    SELECT gameid, 1 AS sgn, unnest(list_distinct({tok_b})) AS token FROM {src}
    UNION ALL
    SELECT gameid, -1, unnest(list_distinct({tok_r})) FROM {src}) t
  JOIN vocab USING (token) GROUP BY gameid, index HAVING sum(sgn) <> 0)"""


def _role_tok(col: str) -> str:
    return (f"list_transform(range(least(len({col}), 5)), "
            f"lambda i: {_ROLE_LIST}[i + 1] || '_' || {duck_norm(col + '[i + 1]')})")


def _plain_tok(col: str) -> str:
    return f"list_transform({col}, lambda c: {duck_norm('c')})"


@register("signed_onehot", _m(_SEEN, _VOCAB_ROLE, *ROLE_ASSIGN_CTES,
                              _onehot_sql(_role_tok("blue_picks_sorted"), _role_tok("red_picks_sorted"), "ra"),
                              select="SELECT gameid, CAST(index AS BIGINT) AS index, value FROM oh"))
def q_signed_onehot(spark, sf):
    """V2 role aware: role-sorted picks (V1) -> role tokens -> vocabulary
    index -> +1 / -1 per team by assignment -> blue + red."""
    s = sorted_matches(spark, sf)
    vocab = V.vocabulary(s, role_aware=True)
    return V.signed_onehot_long(s, vocab, role_aware=True,
                                blue="blue_picks_sorted", red="red_picks_sorted")


@register("signed_onehot_plain", _m(_SEEN, _VOCAB_PLAIN,
                                    _onehot_sql(_plain_tok("blue_picks"), _plain_tok("red_picks"), "matches"),
                                    select="SELECT gameid, CAST(index AS BIGINT) AS index, value FROM oh"))
def q_signed_onehot_plain(spark, sf):
    m = base_matches(spark, sf, reuse=True)
    vocab = V.vocabulary(m, role_aware=False)
    return V.signed_onehot_long(m, vocab, role_aware=False)


@register("hash_bucket", _m(_SEEN, select=f"""
SELECT champion AS token, {duck_hash('champion')} AS h,
       CAST({duck_hash('champion')} % 300 AS INT) AS bucket,
       CASE WHEN ({duck_hash('champion')} // 300) % 2 = 0 THEN 1 ELSE -1 END AS sign
FROM seen"""))
def q_hash_bucket(spark, sf):
    m = base_matches(spark, sf)
    seen = (m.select(F.explode(F.concat("blue_picks", "red_picks")).alias("c"))
            .select(normalize_name("c").alias("token")).distinct())
    h = token_hash("token")
    return seen.select("token", h.alias("h"), bucket(h, 300).alias("bucket"), sign(h, 300).alias("sign"))


def _hashed_sql(n: int, tok_b: str, tok_r: str, src: str, red_off: int, red_sign: int) -> str:
    return f"""hx AS (
  SELECT gameid, CAST({duck_hash('token')} % {n} AS INT) + off AS index,
         (CASE WHEN ({duck_hash('token')} // {n}) % 2 = 0 THEN 1 ELSE -1 END) * sd AS v FROM (
    SELECT gameid, unnest({tok_b}) AS token, 0 AS off, 1 AS sd FROM {src}
    UNION ALL
    SELECT gameid, unnest({tok_r}), {red_off}, {red_sign} FROM {src}))"""


_HX_SELECT = "SELECT gameid, index, CAST(sum(v) AS DOUBLE) AS value FROM hx GROUP BY gameid, index HAVING sum(v) <> 0"


@register("hashed_concat", _m(_hashed_sql(20, _plain_tok("blue_picks"), _plain_tok("red_picks"), "matches", 20, 1),
                              select=_HX_SELECT))
def q_hashed_concat(spark, sf):
    """V5 with n = 20: blue buckets then red buckets (40 features)."""
    return V.hashed_long(base_matches(spark, sf), 20, "concat")


@register("hashed_diff", _m(_hashed_sql(300, _plain_tok("blue_picks"), _plain_tok("red_picks"), "matches", 0, -1),
                            select=_HX_SELECT))
def q_hashed_diff(spark, sf):
    """V6 with n = 300: hash(blue) - hash(red)."""
    return V.hashed_long(base_matches(spark, sf), 300, "diff")


@register("hashed_role_diff", _m(*ROLE_ASSIGN_CTES,
                                 _hashed_sql(300, _role_tok("blue_picks_sorted"), _role_tok("red_picks_sorted"),
                                             "ra", 0, -1),
                                 select=_HX_SELECT))
def q_hashed_role_diff(spark, sf):
    """V7: role-sorted picks (V1) -> role tokens -> hash(blue) - hash(red)."""
    return V.hashed_long(sorted_matches(spark, sf), 300, "role_diff",
                         blue="blue_picks_sorted", red="red_picks_sorted")
