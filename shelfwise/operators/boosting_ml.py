"""The boosted trees of F12 as a stage of an ML Pipeline that can be saved and loaded."""
from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable,
                             MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame

from shelfwise.operators import boosting


class _BoosterParams(Params):
    trees = Param(Params._dummy(), "trees", "number of trees", TypeConverters.toInt)
    leaves = Param(Params._dummy(), "leaves", "most leaves of a tree", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "learning rate", TypeConverters.toFloat)
    bins = Param(Params._dummy(), "bins", "most bins of a feature", TypeConverters.toInt)
    featureColumns = Param(Params._dummy(), "featureColumns", "numeric columns", TypeConverters.toListString)
    categoryColumn = Param(Params._dummy(), "categoryColumn", "the category", TypeConverters.toString)
    labelColumn = Param(Params._dummy(), "labelColumn", "the target", TypeConverters.toString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(trees=300, leaves=31, rate=0.05, bins=64, labelColumn="y")


class LeafwiseBooster(Estimator, _BoosterParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, trees=300, leaves=31, rate=0.05, bins=64, featureColumns=None, categoryColumn=None,
                 labelColumn="y") -> None:
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> LeafwiseBoosterModel:
        get = self.getOrDefault
        settings = boosting.Settings(trees=get("trees"), leaves=get("leaves"), rate=get("rate"), bins=get("bins"))
        fitted = boosting.fit(dataset, get("featureColumns"), get("categoryColumn"), get("labelColumn"), settings)
        return self._copyValues(LeafwiseBoosterModel(fitted))


class LeafwiseBoosterModel(Model, _BoosterParams, MLReadable, MLWritable):
    def __init__(self, boosted: boosting.Boosted | None = None) -> None:
        super().__init__()
        self.boosted = boosted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.boosted.transform(dataset)

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    def __init__(self, model: LeafwiseBoosterModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.boosted.save(f"{path}/trees")


class _ModelReader(MLReader):
    def load(self, path: str) -> LeafwiseBoosterModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = LeafwiseBoosterModel(boosting.Boosted.load(self.sparkSession, f"{path}/trees"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
