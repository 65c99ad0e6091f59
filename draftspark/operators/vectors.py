"""Pick encoders producing vectors.

Every encoder gives the nonzero *entries* of a match, array<struct<index, value>>,
by a projection of its row (summed up by ``Summed.java``): the *long form* - (match, index, value), which is what
the oracle checks - is their explosion, and the ML vector is a sparse vector made
of them in the JVM (``Sparse.java``).

* Signed one-hot (V2/V3): a fitted vocabulary (sorted tokens, index 0..),
  blue picks set +1, red picks -1, per team by *assignment* (a duplicate pick
  counts once), then blue + red, so a mirrored pick cancels.
* Hashing (V5/V6/V7): signed feature hashing (F16) of normalized picks, or
  of ``role_champion`` tokens after role assignment; duplicates add up.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..functions.hashing import bucket, sign, token_hash
from ..functions.names import ROLES, normalize_name, role_tokens
from ..jvm import call
from ..models.persist import StatePersistence
from .lookup import literal_map
from .ordering import global_ordinal


# ---------------------------------------------------------------------------
# Vocabulary and signed one-hot
# ---------------------------------------------------------------------------

def vocabulary(matches: DataFrame, role_aware: bool = True, with_count: bool = False):
    """Sorted token list with 0-based index.  Tokens are every seen
    champion (normalized), crossed with the five roles when role aware.
    They are numbered by the partitioned global ordinal, so no single task
    holds them all."""
    champs = (matches.select(F.explode(F.concat("blue_picks", "red_picks")).alias("c"))
              .select(normalize_name("c").alias("champion")).distinct())
    if role_aware:
        roles = F.array(*[F.lit(r) for r in ROLES])
        tokens = champs.select(F.explode(F.transform(roles, lambda r: F.concat(r, F.lit("_"), F.col("champion"))))
                               .alias("token"))
    else:
        tokens = champs.select(F.col("champion").alias("token"))
    vocab = global_ordinal(tokens, ["token"], "index")
    return (vocab, vocab.count()) if with_count else vocab


def _tokens(picks: str, role_aware: bool) -> Column:
    return role_tokens(F.col(picks)) if role_aware else F.transform(picks, lambda c: normalize_name(c))


def _team_tokens(df: DataFrame, role_aware: bool, blue="blue_picks", red="red_picks",
                 id_col: str = "gameid") -> DataFrame:
    """One row per (match, side, token); sides are +1 (blue) / -1 (red)."""
    def team(picks, side):
        return F.transform(F.array_distinct(_tokens(picks, role_aware)), lambda t: F.struct(F.lit(side).alias("sgn"), t.alias("token")))

    items = F.concat(team(blue, 1), team(red, -1))
    return df.select(F.col(id_col).alias("gameid"), F.inline(items))


_ENTRIES = ArrayType(StructType([StructField("index", LongType()), StructField("value", DoubleType())]))


def _summed(entries: Column) -> Column:
    """Entries in ascending order, equal indices added up, zeros dropped."""
    return call("Summed", _ENTRIES, entries)


def _long_form(df: DataFrame, id_col: str, entries: str | Column) -> DataFrame:
    """(match, index, value).  The outer form infers no filter on the entries,
    which would have them worked out once more below."""
    e = df.select(id_col, F.inline_outer(entries))
    return e.where("index IS NOT NULL")


def with_onehot(df: DataFrame, vocab: DataFrame, out: str, role_aware: bool = True, blue="blue_picks", red="red_picks",
                id_col: str = "gameid") -> DataFrame:
    """Add the signed one-hot entries.  Tokens missing from the vocabulary are
    dropped (J8); a token counts once a team, and one that both teams have
    cancels.  A vocabulary small enough travels in the plan; a larger one is
    joined to the tokens."""
    known = literal_map(vocab.select("token", F.col("index").cast("bigint").alias("index")), "token", "index")
    if known is not None:
        def team(picks, value):
            index = F.array_distinct(F.filter(F.transform(_tokens(picks, role_aware), known), lambda i: i.isNotNull()))
            return F.transform(index, lambda i: F.struct(i.alias("index"), F.lit(value).alias("value")))

        return df.withColumn(out, _summed(F.concat(team(blue, 1.0), team(red, -1.0))))
    joined = _team_tokens(df, role_aware, blue, red, id_col).join(vocab.select("token", "index"), "token")
    long = joined.groupBy(F.col("gameid").alias(id_col), "index").agg(F.sum("sgn").cast("double").alias("value")).where(F.col("value") != 0)
    per = long.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("index", "value"))).alias(out))
    return df.join(per, id_col, "left").withColumn(out, F.coalesce(F.col(out), F.array().cast("array<struct<index:bigint,value:double>>")))


def signed_onehot_long(df: DataFrame, vocab: DataFrame, role_aware: bool = True,
                       blue="blue_picks", red="red_picks", id_col: str = "gameid") -> DataFrame:
    """V2/V3 long form: (gameid, index, value), value != 0."""
    return _long_form(with_onehot(df, vocab, "_e", role_aware, blue, red, id_col), id_col, "_e")


def sparse_vector(entries, size: int) -> Column:
    """array<struct<index,value>>, ascending, as a sparse vector of ``size``."""
    return call("Sparse", VectorUDT(), F.col(entries) if isinstance(entries, str) else entries, F.lit(size))


class _VecParams(Params):
    roleAware = Param(Params._dummy(), "roleAware", "role-aware tokens", TypeConverters.toBoolean)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)
    numFeatures = Param(Params._dummy(), "numFeatures", "hash buckets", TypeConverters.toInt)
    blueCol = Param(Params._dummy(), "blueCol", "blue picks column", TypeConverters.toString)
    redCol = Param(Params._dummy(), "redCol", "red picks column", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "match key", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(roleAware=True, outputCol="onehot", numFeatures=300,
                         blueCol="blue_picks", redCol="red_picks", idCol="gameid")

    def _p(self, name):
        return self.getOrDefault(getattr(self, name))


class ChampionEmbeddingModel(Model, _VecParams, StatePersistence):
    def __init__(self):
        super().__init__()
        self._state, self._scalars = {}, {}

    def _transform(self, df):
        out = with_onehot(df, self._state["vocab"], "_e", self._p("roleAware"), self._p("blueCol"), self._p("redCol"), self._p("idCol"))
        return out.withColumn(self._p("outputCol"), sparse_vector("_e", int(self._scalars["n"]))).drop("_e")


class ChampionEmbedding(Estimator, _VecParams):
    """V2/V3: fit a vocabulary; transform to signed one-hot (blue - red).
    For role-aware use, feed role-sorted pick columns (V1) via blueCol/redCol."""

    def __init__(self, **kw):
        super().__init__()
        self._set(**kw)

    def _fit(self, df):
        vocab, n = vocabulary(df.select(F.col(self._p("blueCol")).alias("blue_picks"),
                                        F.col(self._p("redCol")).alias("red_picks")),
                              self._p("roleAware"), with_count=True)
        m = ChampionEmbeddingModel()
        self._copyValues(m)
        m._state, m._scalars = {"vocab": vocab.checkpoint(eager=True)}, {"n": n}
        return m


# ---------------------------------------------------------------------------
# Hashing
# ---------------------------------------------------------------------------

def hashed_entries(n: int, mode: str, blue="blue_picks", red="red_picks") -> Column:
    """Nonzero entries of the hashed encoders, ascending; equal indices add up.

    mode ``concat`` (V5): blue in [0, n), red in [n, 2n), both with the hash sign.
    mode ``diff`` (V6): blue - red in [0, n).
    mode ``role_diff`` (V7): like diff, tokens ``role_champion`` of role-sorted picks.
    """
    def team(picks, offset, side):
        hashes = F.transform(_tokens(picks, mode == "role_diff"), token_hash)
        return F.transform(hashes, lambda h: F.struct((bucket(h, n) + offset).cast("bigint").alias("index"), (sign(h, n) * side).cast("double").alias("value")))

    items = F.concat(team(blue, 0, 1), team(red, n, 1) if mode == "concat" else team(red, 0, -1))
    return _summed(items)


def hashed_long(df: DataFrame, n: int, mode: str, blue="blue_picks", red="red_picks",
                id_col: str = "gameid") -> DataFrame:
    """Long form of the hashed encoders: (match, index, value), value != 0."""
    out = _long_form(df, id_col, hashed_entries(n, mode, blue, red))
    return out.withColumn("index", F.col("index").cast("int"))


class PickHasher(Transformer, _VecParams, DefaultParamsReadable, DefaultParamsWritable):
    """V5 (mode concat, 2n features), V6 (diff), V7 (role_diff; feed
    role-sorted picks).  Stateless: no fit needed."""

    mode = Param(Params._dummy(), "mode", "concat | diff | role_diff", TypeConverters.toString)

    def __init__(self, **kw):
        super().__init__()
        self._setDefault(mode="diff", outputCol="hashed")
        self._set(**kw)

    def _transform(self, df):
        n, mode = self._p("numFeatures"), self.getOrDefault(self.mode)
        entries = hashed_entries(n, mode, self._p("blueCol"), self._p("redCol"))
        return df.withColumn(self._p("outputCol"), sparse_vector(entries, 2 * n if mode == "concat" else n))
