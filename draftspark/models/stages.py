"""Feature stages for the model pipelines (V1 as a stage, V12, V13) and the
stage lists of each reference model."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters

from ..operators.encoders import (ChampionWinRateEstimator, TeamSideWinRateEstimator, TeamStrengthEncoder,
                                  TeamTargetEncoder)
from ..operators.roles import assign_roles, role_stats_long
from ..operators.vectors import ChampionEmbedding, PickHasher
from .persist import StatePersistence


class _RoleParams(Params):
    idCol = Param(Params._dummy(), "idCol", "match key", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(idCol="gameid")


class RoleAssignerModel(Model, _RoleParams, StatePersistence):
    def __init__(self):
        super().__init__()
        self._state, self._scalars = {}, {}

    def _transform(self, df):
        return assign_roles(df, self._state["stats"], id_col=self.getOrDefault(self.idCol))


class RoleAssigner(Estimator, _RoleParams):
    """V1 as a pipeline stage: role statistics (A16) are taken from the
    training rows; transform adds ``blue_picks_sorted``/``red_picks_sorted``."""

    def __init__(self, **kw):
        super().__init__()
        self._set(**kw)

    def _fit(self, df):
        stats = role_stats_long(df).checkpoint(eager=True)
        m = RoleAssignerModel()
        self._copyValues(m)
        m._state, m._scalars = {"stats": stats}, {}
        return m


def role_embedding_stages(id_col: str = "gameid"):
    return [RoleAssigner(idCol=id_col),
            ChampionEmbedding(roleAware=True, blueCol="blue_picks_sorted", redCol="red_picks_sorted",
                              outputCol="onehot", idCol=id_col)]


def winner_features(id_col: str = "gameid", encoder_label: str = "result"):
    """M1/M3/M4/M5/M6: role-aware signed one-hot + team strength + blue side."""
    return [*role_embedding_stages(id_col),
            TeamStrengthEncoder(smoothing=15.0, labelCol=encoder_label),
            VectorAssembler(inputCols=["onehot", "blue_team_strength", "red_team_strength", "blue_side"],
                            outputCol="features")]


def ultimate_features(id_col: str = "gameid", encoder_label: str = "result"):
    """M2: + champion win rates (V8) and team side win rates (V9)."""
    return [*role_embedding_stages(id_col),
            TeamStrengthEncoder(smoothing=15.0, labelCol=encoder_label),
            ChampionWinRateEstimator(smoothing=10.0, labelCol=encoder_label, idCol=id_col),
            TeamSideWinRateEstimator(smoothing=10.0, labelCol=encoder_label),
            VectorAssembler(inputCols=["onehot", "blue_team_strength", "red_team_strength",
                                       "blue_champ_wr", "red_champ_wr", "blue_side_wr", "red_side_wr"],
                            outputCol="features")]


def encoded_features(team_stage, extra=(), scale: bool = False):
    """A team encoder beside hashed picks (column ``hashed``), assembled (+ side
    flags), optionally standardized (V13)."""
    team_cols = ["blue_team_enc", "red_team_enc"] if not isinstance(team_stage, TeamStrengthEncoder) \
        else ["blue_team_strength", "red_team_strength"]
    stages = [team_stage, VectorAssembler(inputCols=["hashed", *team_cols, *extra],
                                          outputCol="raw_features" if scale else "features")]
    if scale:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True))
    return stages


def hashed_features(n: int, team_stage, id_col: str = "gameid", extra=(), scale: bool = False):
    """blue||red hashed picks (V5) + a team encoder (+ side flags),
    optionally standardized (V13)."""
    return [PickHasher(mode="concat", numFeatures=n, outputCol="hashed", idCol=id_col), *encoded_features(team_stage, extra, scale)]


__all__ = ["RoleAssigner", "RoleAssignerModel", "winner_features", "ultimate_features", "hashed_features", "encoded_features",
           "TeamTargetEncoder"]
