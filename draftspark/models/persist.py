"""Persistence for fitted models whose state is a few small tables.

Params go through Spark ML's own metadata writer; each state table is
written as parquet beside it, scalars go into the metadata.  A fitted model
therefore reloads in any session without pickling Python objects.
"""

from __future__ import annotations

import json

from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter


class _StateWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        inst = self.instance
        extra = {"scalars": json.dumps(inst._scalars), "tables": sorted(inst._state)}
        DefaultParamsWriter.saveMetadata(inst, path, self.sparkSession.sparkContext, extraMetadata=extra)
        for name, df in inst._state.items():
            df.write.mode("overwrite").parquet(f"{path}/state/{name}")


class _StateReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession.sparkContext)
        inst = self.cls()
        inst._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(inst, meta)
        inst._scalars = json.loads(meta["scalars"])
        inst._state = {n: self.sparkSession.read.parquet(f"{path}/state/{n}") for n in meta["tables"]}
        return inst


class StatePersistence(MLWritable, MLReadable):
    """Mixin: ``_state`` (name -> DataFrame) and ``_scalars`` (json-able)."""

    _state: dict
    _scalars: dict

    def write(self) -> MLWriter:
        return _StateWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StateReader(cls)
