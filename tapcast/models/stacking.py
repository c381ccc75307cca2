"""Stacking of boosted base models (M9, V4) as an Estimator/Model pair with
Params and persistence (X3).

fit: for every base preset and every origin, fit on the rows before the
origin (round count chosen by the origin day's MAE, as early stopping) and
predict the origin's rows; the out-of-fold predictions are
columns ``pred_<name>`` on rows keyed by (station, date, slot), stacked over
origins by name, and the meta model, any Spark regressor, is fitted on them.
transform: each base preset predicts with the mean of its origin models,
then the meta model combines them.

Both are saved with what they hold: the estimator with its presets and its
meta regressor, the model with every base model and the fitted meta model.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import GBTRegressionModel, LinearRegression
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapcast.models.boosting import L1_DEPTH5, L1_DEPTH6, L2_DEPTH9, BoosterSpec, fit_best_rounds
from tapcast.operators.validation import fold


class _StackParams(Params):
    labelCol = Param(Params._dummy(), "labelCol", "target", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "the stack's prediction", TypeConverters.toString)
    origins = Param(Params._dummy(), "origins", "origin days (ISO dates), oldest first", TypeConverters.toListString)
    dateCol = Param(Params._dummy(), "dateCol", "service date of a row", TypeConverters.toString)
    selectRounds = Param(Params._dummy(), "selectRounds", "choose rounds by the origin day's MAE",
                         TypeConverters.toBoolean)
    workers = Param(Params._dummy(), "workers", "base fits that run side by side", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(predictionCol="prediction", dateCol="service_date", selectRounds=True, workers=4)


class StackedBoosters(Estimator, _StackParams, MLWritable, MLReadable):
    """``meta``: a regressor with features, label and prediction columns; by
    default a linear one with ``reg_param``."""

    def __init__(self, label: str | None = None, origins=(), bases=(L1_DEPTH6, L1_DEPTH5, L2_DEPTH9),
                 output_col: str = "prediction", reg_param: float = 0.0, workers: int = 4,
                 select_rounds: bool = True, meta: Estimator | None = None):
        super().__init__()
        self.bases = list(bases)
        self.meta = meta if meta is not None else LinearRegression(regParam=reg_param)
        self._set(origins=[str(o) for o in origins], predictionCol=output_col, workers=workers,
                  selectRounds=select_rounds)
        if label is not None:
            self._set(labelCol=label)

    def _fit(self, rows: DataFrame) -> "StackedBoostersModel":
        label, date = self.getOrDefault("labelCol"), self.getOrDefault("dateCol")
        origins, output = self.getOrDefault("origins"), self.getOrDefault("predictionCol")
        # Base fits per (preset, origin) are independent: submit them from
        # driver threads so their jobs overlap.
        jobs = [(b, o) for o in origins for b in self.bases]

        def fit_base(b, o):
            tr, va = fold(rows, o, date)
            if not self.getOrDefault("selectRounds"):
                return b.estimator(label).fit(tr)
            # Early stopping on the origin day: the best rounds of the fit on
            # the rows before it.
            return fit_best_rounds(b, tr, va, label)[2]

        with ThreadPoolExecutor(max_workers=min(self.getOrDefault("workers"), len(jobs))) as ex:
            futs = {(b.name, o): ex.submit(fit_base, b, o) for b, o in jobs}
            fitted = {k: f.result() for k, f in futs.items()}
        base_models = {b.name: [fitted[(b.name, o)] for o in origins] for b in self.bases}
        oof_parts = []
        for o in origins:
            part = fold(rows, o, date)[1]
            for b in self.bases:
                part = (fitted[(b.name, o)].transform(part)
                        .withColumnRenamed("prediction", f"pred_{b.name}"))
            oof_parts.append(part)
        oof = oof_parts[0]
        for p in oof_parts[1:]:
            oof = oof.unionByName(p)
        pred_cols = [f"pred_{b.name}" for b in self.bases]
        meta_in = VectorAssembler(inputCols=pred_cols, outputCol="meta_features").transform(oof)
        meta = self.meta.copy({self.meta.featuresCol: "meta_features", self.meta.labelCol: label,
                               self.meta.predictionCol: output}).fit(meta_in)
        return self._copyValues(StackedBoostersModel(base_models, meta))

    def write(self) -> MLWriter:
        return _StackWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StackReader(cls)


class StackedBoostersModel(Model, _StackParams, MLWritable, MLReadable):
    def __init__(self, base_models: dict | None = None, meta=None):
        super().__init__()
        self.base_models, self.meta = base_models or {}, meta

    @property
    def pred_cols(self) -> list:
        return [f"pred_{name}" for name in self.base_models]

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df
        for name, models in self.base_models.items():
            cols = []
            for i, m in enumerate(models):
                c = f"_pred_{name}_{i}"
                out = m.transform(out).withColumnRenamed("prediction", c)
                cols.append(c)
            out = out.withColumn(f"pred_{name}",
                                 sum((F.col(c) for c in cols), F.lit(0.0)) / len(cols)).drop(*cols)
        out = VectorAssembler(inputCols=self.pred_cols, outputCol="meta_features").transform(out)
        return self.meta.transform(out).drop("meta_features")

    def write(self) -> MLWriter:
        return _StackModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StackModelReader(cls)


class _NestedWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def nested(self, part: MLWritable, path: str) -> None:
        writer = part.write()
        (writer.overwrite() if self.shouldOverwrite else writer).save(path)


class _StackWriter(_NestedWriter):
    """Params and presets as metadata, the meta regressor next to them."""

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession,
                                         extraMetadata={"bases": [asdict(b) for b in self.instance.bases]})
        self.nested(self.instance.meta, f"{path}/meta")


class _StackModelWriter(_NestedWriter):
    """Params and the base models' names as metadata; every model in a folder
    of its own."""

    def saveImpl(self, path: str) -> None:
        m = self.instance
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession,
                                         extraMetadata={"bases": [[k, len(v)] for k, v in m.base_models.items()]})
        for name, models in m.base_models.items():
            for i, model in enumerate(models):
                self.nested(model, f"{path}/bases/{name}/{i}")
        self.nested(m.meta, f"{path}/meta")


class _StackReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        found = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        meta = DefaultParamsReader.loadParamsInstance(f"{path}/meta", self.sparkSession)
        out = self.build(found, meta, path)
        out._resetUid(found["uid"])
        DefaultParamsReader.getAndSetParams(out, found)
        return out

    def build(self, found: dict, meta, path: str):
        return self.cls(bases=[BoosterSpec(**b) for b in found["bases"]], meta=meta)


class _StackModelReader(_StackReader):
    def build(self, found: dict, meta, path: str):
        return self.cls({name: [GBTRegressionModel.load(f"{path}/bases/{name}/{i}") for i in range(n)]
                         for name, n in found["bases"]}, meta)
