"""Gradient-boosted forecasts with Spark ML.

Three tree presets stand in for the three booster libraries: absolute loss
at depth 6 and depth 5, squared loss at depth 9. Per rolling origin a
model is fitted on the rows before the origin and the round count with the
lowest MAE on the origin day is kept (``evaluateEachIteration``); while the
best round is the last one, twice the rounds are judged, up to ``max_rounds``.
Each preset is then refitted once on every training row, with the most rounds
that any origin chose; an origin's model is a prefix of its trees, for the
first trees of a longer fit are those of a shorter one (same rows, same seed).
For the same reason one fit stands for all doublings up to its own rounds:
``next_rounds`` leaves out fits that cannot be the last. Fold predictions are
averaged; two presets can be blended.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark import SparkContext
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapcast.operators.validation import fold
from tapcast.session import materialize

NON_FEATURES = {"service_date", "slot", "in_nums", "out_nums", "features"}


@dataclass(frozen=True)
class BoosterSpec:
    name: str
    loss: str = "absolute"
    max_depth: int = 6
    step_size: float = 0.1
    subsampling: float = 0.9
    feature_subset: str = "0.9"
    max_iter: int = 20
    max_rounds: int = 10_000
    max_bins: int = 32
    min_instances: int = 1
    seed: int = 0

    def estimator(self, label: str, max_iter: int | None = None) -> GBTRegressor:
        return GBTRegressor(featuresCol="features", labelCol=label, predictionCol="prediction",
                            lossType=self.loss, maxDepth=self.max_depth,
                            stepSize=self.step_size, subsamplingRate=self.subsampling,
                            featureSubsetStrategy=self.feature_subset,
                            maxIter=max_iter or self.max_iter, maxBins=self.max_bins,
                            minInstancesPerNode=self.min_instances, seed=self.seed)


# Fixed values of the presets.
# L1 loss, depth 6, row and feature sampling 0.9 (M1, M2).
L1_DEPTH6 = BoosterSpec("l1_d6", "absolute", 6, 0.1, 0.9, "0.9")
# L1 loss, depth 5, step 0.08, no sampling (M3, M4).
L1_DEPTH5 = BoosterSpec("l1_d5", "absolute", 5, 0.08, 1.0, "all")
# Squared loss, depth 9, step 0.0894, sampling 0.8 (M5).
L2_DEPTH9 = BoosterSpec("l2_d9", "squared", 9, 0.0894, 0.8, "0.8")


def feature_columns(df: DataFrame) -> list:
    return [c for c, t in df.dtypes
            if c not in NON_FEATURES and t in ("int", "bigint", "double", "float")]


def assemble(df: DataFrame, features: list) -> DataFrame:
    """Feature vector; a missing feature counts as 0 (the frames' convention)
    because Spark's tree learners reject NaN."""
    return VectorAssembler(inputCols=features, outputCol="features",
                           handleInvalid="keep").transform(df.na.fill(0, subset=features))


def prefix(model: GBTRegressionModel, rounds: int) -> GBTRegressionModel:
    """The model of the first ``rounds`` trees."""
    if rounds >= model.getNumTrees:
        return model
    java, gateway = model._java_obj, SparkContext._active_spark_context._gateway  # noqa: SLF001
    trees = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(gateway.jvm.double, rounds)
    for i, (tree, weight) in enumerate(zip(java.trees()[:rounds], model.treeWeights)):
        trees[i], weights[i] = tree, weight
    cut = gateway.jvm.org.apache.spark.ml.regression.GBTRegressionModel(f"{model.uid}_{rounds}", trees, weights)
    for c in ("featuresCol", "predictionCol"):
        cut.set(c, model.getOrDefault(c))
    return GBTRegressionModel(cut)


def settled_rounds(spec: BoosterSpec, errs: list) -> int | None:
    """The rounds chosen from the errors of every round: the best of the first
    ``max_iter``, of twice as many while the best is the last one, and so on
    up to ``max_rounds``. None: more rounds than ``errs`` has are needed."""
    cap = min(spec.max_iter, spec.max_rounds)
    while cap <= len(errs):
        best = min(range(cap), key=lambda i: errs[i])
        if best + 1 < cap or cap >= spec.max_rounds:
            return best + 1
        cap = min(2 * cap, spec.max_rounds)
    return None


def next_rounds(spec: BoosterSpec, errs: list) -> int:
    """Rounds of the fit after one that did not settle: a doubling, which only
    the cost depends on. With absolute loss a leaf is a mean of signs, so a
    round moves a prediction by less than ``step_size``, about half of it,
    whatever the size of the label. While the error falls as fast as at first,
    the first doubling that moves by the whole error is taken, not each one on
    the way."""
    cap, half = 2 * len(errs), len(errs) // 2
    if spec.loss == "absolute" and errs[half] - errs[-1] > (errs[0] - errs[half]) / 2:
        while cap < spec.max_rounds and cap * spec.step_size / 2 < errs[-1]:
            cap *= 2
    return min(cap, spec.max_rounds)


def fit_best_rounds(spec: BoosterSpec, train: DataFrame, valid: DataFrame, label: str):
    """(rounds with the lowest valid MAE, that MAE, the model of so many
    rounds on train). Without rows on the origin day there is nothing to
    choose by: an error."""
    if valid.isEmpty():
        raise ValueError("no rows on the origin day to choose the rounds by")
    cap = min(spec.max_iter, spec.max_rounds)
    while True:
        model = spec.estimator(label, cap).fit(train)
        errs = model.evaluateEachIteration(valid, "absolute")
        rounds = settled_rounds(spec, errs)
        if rounds is not None:
            return rounds, float(errs[rounds - 1]), prefix(model, rounds)
        cap = next_rounds(spec, errs)


def fit_fold_models(jobs, rows: DataFrame, refit: bool = True, workers: int = 4) -> dict:
    """Fit every (spec, label, origin) job; independent jobs are submitted
    from driver threads so their Spark jobs overlap on the cluster. A preset
    and target is refitted as soon as its own origins have chosen.
    Returns {(spec name, label, origin): (model, rounds, valid MAE)}; rounds
    equal to the spec's ``max_rounds`` mean that the limit was reached."""
    jobs = list(jobs)

    def refitted(s, lab, origins):
        return s.estimator(lab, max(f.result()[0] for f in origins)).fit(rows)

    with ThreadPoolExecutor(max_workers=max(1, min(workers, len(jobs)))) as ex:
        futs = {(s, lab, o): ex.submit(fit_best_rounds, s, *fold(rows, o), lab) for s, lab, o in jobs}
        full: dict = {}
        if refit:
            # Taken up in this order, after all of the choices: none waits for
            # a choice that has not begun.
            for s, lab in dict.fromkeys((s, lab) for s, lab, _ in jobs):
                full[s, lab] = ex.submit(refitted, s, lab, [f for k, f in futs.items() if k[:2] == (s, lab)])
        chosen = {k: f.result() for k, f in futs.items()}
        if not refit:
            return {(s.name, lab, o): (m, n, err) for (s, lab, o), (n, err, m) in chosen.items()}
        full = {k: f.result() for k, f in full.items()}
    return {(s.name, lab, o): (prefix(full[s, lab], n), n, err)
            for (s, lab, o), (n, err, _) in chosen.items()}


def apply_fold_average(score: DataFrame, models: dict, spec_name: str, label: str, origins,
                       pred_col: str) -> DataFrame:
    """``pred_col`` = mean of the origin models' predictions."""
    out, cols = score, []
    for i, o in enumerate(origins):
        c = f"_{pred_col}_{i}"
        out = models[(spec_name, label, o)][0].transform(out).withColumnRenamed("prediction", c)
        cols.append(c)
    avg = sum((F.col(c) for c in cols), F.lit(0.0)) / len(cols)
    return out.withColumn(pred_col, avg).drop(*cols)


def fold_average(spec: BoosterSpec, rows: DataFrame, score: DataFrame, origins, label: str,
                 pred_col: str, refit: bool = True, workers: int = 4):
    """Score rows with ``pred_col`` = mean over origins of the refitted
    model's prediction; also returns the per-origin (origin, rounds, mae)."""
    models = fit_fold_models([(spec, label, o) for o in origins], rows, refit, workers)
    report = [(o, models[(spec.name, label, o)][1], models[(spec.name, label, o)][2])
              for o in origins]
    return apply_fold_average(score, models, spec.name, label, origins, pred_col), report


def prepare(all_rows: DataFrame, model_rows: DataFrame, score_rows: DataFrame):
    """Assemble features once and cut lineage before the many fits."""
    feats = feature_columns(all_rows)
    rows = materialize(assemble(model_rows, feats))
    score = materialize(assemble(score_rows, feats))
    return rows, score, feats


def forecast(rows: DataFrame, score: DataFrame, origins, spec: BoosterSpec = L1_DEPTH6,
             targets=(("in_nums", "in_pred"), ("out_nums", "out_pred")),
             workers: int = 4) -> DataFrame:
    """Fold-averaged predictions of one preset for both targets."""
    models = fit_fold_models([(spec, lab, o) for lab, _ in targets for o in origins],
                             rows, workers=workers)
    out = score
    for label, pred in targets:
        out = apply_fold_average(out, models, spec.name, label, origins, pred)
    return out


def blend(rows: DataFrame, score: DataFrame, origins, specs=(L1_DEPTH5, L1_DEPTH6),
          weights=None, targets=(("in_nums", "in_pred"), ("out_nums", "out_pred")),
          workers: int = 4) -> DataFrame:
    """Weighted mean of several presets' fold-averaged predictions (M8)."""
    weights = list(weights or [1.0 / len(specs)] * len(specs))
    models = fit_fold_models([(s, lab, o) for s in specs for lab, _ in targets for o in origins],
                             rows, workers=workers)
    out = score
    for label, pred in targets:
        parts = []
        for spec in specs:
            col = f"{pred}_{spec.name}"
            out = apply_fold_average(out, models, spec.name, label, origins, col)
            parts.append(col)
        out = out.withColumn(pred, sum((F.col(c) * w for c, w in zip(parts, weights)),
                                       F.lit(0.0)))
    return out


def with_rounds(spec: BoosterSpec, max_iter: int) -> BoosterSpec:
    """The preset with at most ``max_iter`` rounds."""
    return replace(spec, max_iter=max_iter, max_rounds=max_iter)
