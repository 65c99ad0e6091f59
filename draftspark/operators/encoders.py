"""Team and champion encoders.

Each encoder has a plain table builder (usable on its own and checked
against DuckDB) and a ``pyspark.ml`` Estimator/Model pair so it can sit in a
Pipeline and be refitted per CV fold (no leakage).  Fitting is a map-side
combined ``groupBy`` on the key; scoring is a size-checked lookup join.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalize_name
from ..models.persist import StatePersistence
from .lookup import lookup

# ---------------------------------------------------------------------------
# Table builders
# ---------------------------------------------------------------------------


def team_appearances(matches: DataFrame, label: str, invert_red: bool = True) -> DataFrame:
    """One row per (match, side) with the side's target; red gets
    ``1 - y`` when ``invert_red`` (win labels), else the same ``y``."""
    y = F.col(label).cast("double")
    red_y = (F.lit(1.0) - y) if invert_red else y
    both = F.array(F.struct(F.col("blue_team").alias("team"), y.alias("y")),
                   F.struct(F.col("red_team").alias("team"), red_y.alias("y")))
    return matches.select(F.inline(both))


def scalar(df: DataFrame, expr: Column, default: float | None = None) -> float | None:
    """One aggregate value (a single number reaches the driver)."""
    v = df.agg(expr.alias("v")).first()["v"]
    return default if v is None else float(v)


def _ckpt(df: DataFrame) -> DataFrame:
    """Materialize a (small) fitted table in the shared checkpoint folder:
    the input is scanned once, later reads hit the table."""
    return df.checkpoint(eager=True)


def sigmoid_target_table(app: DataFrame, smoothing: float, min_samples_leaf: float = 20.0):
    """Sigmoid-smoothed target mean per team.

    ``lam = 1 / (1 + exp(-(n - k) / s))``; ``enc = prior (1 - lam) + mean lam``.
    One pass over the input: the prior comes from the per-team sums.
    Returns (table[team, n, mean, enc], prior)."""
    stats = _ckpt(app.groupBy("team").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"),
                                          F.avg("y").alias("mean")))
    tot = stats.agg(F.sum("sy").alias("sy"), F.sum("n").alias("n")).first()
    prior = float(tot["sy"]) / tot["n"] if tot["n"] else 0.5
    lam = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("n") - F.lit(float(min_samples_leaf))) / F.lit(float(smoothing))))
    table = stats.withColumn("enc", F.lit(prior) * (F.lit(1.0) - lam) + F.col("mean") * lam).drop("sy")
    return table, prior


def champion_games(matches: DataFrame, label: str = "result") -> DataFrame:
    """One row per pick: normalized champion and whether its side won."""
    y = F.col(label).cast("int")
    items = F.concat(
        F.transform("blue_picks", lambda c: F.struct(normalize_name(c).alias("champion"), y.alias("win"))),
        F.transform("red_picks", lambda c: F.struct(normalize_name(c).alias("champion"), (F.lit(1) - y).alias("win"))))
    return matches.select(F.inline(items))


def champion_win_rate_table(matches: DataFrame, smoothing: float = 10.0, label: str = "result"):
    """A10: ``(wins + m g) / (games + m)`` with g = all wins / all picks.
    Returns (table[champion, wins, games, win_rate], g)."""
    games = champion_games(matches, label)
    stats = _ckpt(games.groupBy("champion").agg(F.sum("win").alias("wins"), F.count(F.lit(1)).alias("games")))
    tot = stats.agg(F.sum("wins").alias("w"), F.sum("games").alias("n")).first()
    g = (tot["w"] / tot["n"]) if tot["n"] else 0.5
    m = F.lit(float(smoothing))
    rate = (F.col("wins") + m * F.lit(g)) / (F.col("games") + m)
    return stats.withColumn("win_rate", rate), g


def _side_stats(matches: DataFrame, y: Column) -> DataFrame:
    """One pass: per (side, team) games, label sum, label mean."""
    both = F.array(F.struct(F.lit("blue").alias("side"), F.col("blue_team").alias("team"), y.alias("y")),
                   F.struct(F.lit("red").alias("side"), F.col("red_team").alias("team"), y.alias("y")))
    return _ckpt(matches.select(F.inline(both)).groupBy("side", "team").agg(
        F.count(F.lit(1)).alias("games"), F.sum("y").alias("sy"), F.avg("y").alias("mean")))


def team_side_win_rate_tables(matches: DataFrame, smoothing: float = 10.0, label: str = "result"):
    """Per-side smoothed team win rate; blue prior g = mean(y), red 1 - g.
    Returns (blue[team, games, wins, rate], red[...], g)."""
    st = _side_stats(matches, F.col(label).cast("int"))
    tot = st.where("side = 'blue'").agg(F.sum("sy").alias("w"), F.sum("games").alias("n")).first()
    g = float(tot["w"]) / tot["n"] if tot["n"] else 0.5
    m = F.lit(float(smoothing))
    blue = (st.where("side = 'blue'").select("team", "games", F.col("sy").cast("bigint").alias("wins"))
            .withColumn("rate", (F.col("wins") + m * F.lit(g)) / (F.col("games") + m)))
    red = (st.where("side = 'red'").select("team", "games", (F.col("games") - F.col("sy")).cast("bigint").alias("wins"))
           .withColumn("rate", (F.col("wins") + m * F.lit(1.0 - g)) / (F.col("games") + m)))
    return blue, red, g


def team_side_mean_tables(matches: DataFrame, label: str):
    """Unsmoothed mean of ``label`` per blue team and per red team."""
    st = _side_stats(matches, F.col(label).cast("double"))
    return (st.where("side = 'blue'").select("team", "mean"), st.where("side = 'red'").select("team", "mean"))


def pick_score(matches: DataFrame, table: DataFrame, default: float,
               id_col: str = "gameid", divisor: float = 5.0) -> DataFrame:
    """Per match, sum of the champions' rates (unseen -> ``default``)
    divided by ``divisor`` for blue and red.  Explode + lookup + regroup on
    the match key; when the input is already partitioned on the key (as
    reconstructed matches are) neither the regroup nor the join back adds an
    exchange.  The input is read twice (explode branch and join back), so an
    expensively derived input should be materialized first (the registered
    queries checkpoint the match table)."""
    items = F.concat(
        F.transform("blue_picks", lambda c: F.struct(normalize_name(c).alias("champion"), F.lit(1).alias("is_blue"))),
        F.transform("red_picks", lambda c: F.struct(normalize_name(c).alias("champion"), F.lit(0).alias("is_blue"))))
    picks = matches.select(id_col, F.inline(items))
    scored = lookup(picks, table, "champion", "champion", {"win_rate": "r"}, default=default)
    agg = scored.groupBy(id_col).agg(
        F.sum(F.when(F.col("is_blue") == 1, F.col("r")).otherwise(0.0)).alias("blue_champ_wr"),
        F.sum(F.when(F.col("is_blue") == 0, F.col("r")).otherwise(0.0)).alias("red_champ_wr"))
    out = matches.join(agg, id_col, "left")
    return (out.withColumn("blue_champ_wr", F.coalesce("blue_champ_wr", F.lit(0.0)) / F.lit(divisor))
               .withColumn("red_champ_wr", F.coalesce("red_champ_wr", F.lit(0.0)) / F.lit(divisor)))


# ---------------------------------------------------------------------------
# Estimators
# ---------------------------------------------------------------------------

class _EncParams(Params):
    labelCol = Param(Params._dummy(), "labelCol", "target column", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "match key", TypeConverters.toString)
    smoothing = Param(Params._dummy(), "smoothing", "smoothing strength", TypeConverters.toFloat)
    minSamplesLeaf = Param(Params._dummy(), "minSamplesLeaf", "sigmoid midpoint k", TypeConverters.toFloat)
    invertRed = Param(Params._dummy(), "invertRed", "red side target is 1 - y", TypeConverters.toBoolean)
    outputPrefix = Param(Params._dummy(), "outputPrefix", "output column prefix", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(labelCol="result", idCol="gameid", smoothing=10.0, minSamplesLeaf=20.0,
                         invertRed=True, outputPrefix="")

    def _p(self, name):
        return self.getOrDefault(getattr(self, name))


class _EncModel(Model, _EncParams, StatePersistence):
    def __init__(self):
        super().__init__()
        self._state, self._scalars = {}, {}


class _EncEstimator(Estimator, _EncParams):
    _model_cls: type

    def __init__(self, **kw):
        super().__init__()
        self._set(**kw)

    def _make(self, state: dict, scalars: dict):
        m = self._model_cls()
        self._copyValues(m)
        m._state = state
        m._scalars = scalars
        return m


class TeamStrengthModel(_EncModel):
    def _transform(self, df):
        t, s = self._state["teams"], self._scalars
        out = lookup(df, t, "blue_team", "team", {"enc": "blue_team_strength"}, default=s["prior"])
        return lookup(out, t, "red_team", "team", {"enc": "red_team_strength"}, default=s["prior"])


class TeamStrengthEncoder(_EncEstimator):
    """Sigmoid target encoding of both teams over pooled appearances."""
    _model_cls = TeamStrengthModel

    def __init__(self, **kw):
        super().__init__(**{"smoothing": 15.0, **kw})

    def _fit(self, df):
        app = team_appearances(df, self._p("labelCol"), self._p("invertRed"))
        table, prior = sigmoid_target_table(app, self._p("smoothing"), self._p("minSamplesLeaf"))
        return self._make({"teams": table}, {"prior": prior})


class ChampionWinRateModel(_EncModel):
    def _transform(self, df):
        s = self._scalars
        return pick_score(df, self._state["champions"], s["g"], self._p("idCol"))


class ChampionWinRateEstimator(_EncEstimator):
    """V8: mean smoothed champion win rate of each side's composition (÷5)."""
    _model_cls = ChampionWinRateModel

    def _fit(self, df):
        table, g = champion_win_rate_table(df, self._p("smoothing"), self._p("labelCol"))
        return self._make({"champions": table}, {"g": g})


class TeamSideWinRateModel(_EncModel):
    def _transform(self, df):
        s = self._scalars
        out = lookup(df, self._state["blue"], "blue_team", "team", {"rate": "blue_side_wr"}, default=s["g"])
        return lookup(out, self._state["red"], "red_team", "team", {"rate": "red_side_wr"},
                      default=1.0 - s["g"])


class TeamSideWinRateEstimator(_EncEstimator):
    """V9: smoothed team win rate on its side."""
    _model_cls = TeamSideWinRateModel

    def _fit(self, df):
        blue, red, g = team_side_win_rate_tables(df, self._p("smoothing"), self._p("labelCol"))
        return self._make({"blue": blue, "red": red}, {"g": g})


class TeamTargetMeanModel(_EncModel):
    def _transform(self, df):
        out = lookup(df, self._state["blue"], "blue_team", "team", {"mean": "blue_team_enc"}, default=0.5)
        return lookup(out, self._state["red"], "red_team", "team", {"mean": "red_team_enc"}, default=0.5)


class TeamTargetEncoder(_EncEstimator):
    """Unsmoothed per-side team mean of the label; unseen -> 0.5."""
    _model_cls = TeamTargetMeanModel

    def _fit(self, df):
        blue, red = team_side_mean_tables(df, self._p("labelCol"))
        return self._make({"blue": blue, "red": red}, {})
