"""The stack as a saved Estimator and Model; boosters against their trees."""
import datetime as dt
import os
import random
import re

import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor

from tapcast.models.boosting import L1_DEPTH5, L1_DEPTH6, L2_DEPTH9, assemble, with_rounds
from tapcast.models.stacking import StackedBoosters, StackedBoostersModel
from tapcast.session import materialize

DAY = dt.date(2024, 1, 1)
ORIGINS = [DAY + dt.timedelta(days=k) for k in (7, 14)]
BASES = (with_rounds(L1_DEPTH6, 2), with_rounds(L1_DEPTH5, 2))


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(s, DAY + dt.timedelta(days=d), h, rng.random(), float(h * (s + 1) + rng.randint(0, 3)))
            for s in range(4) for d in range(16) for h in range(16)]
    df = spark.createDataFrame(data, "station_id int, service_date date, hour int, x double, in_nums double")
    return materialize(assemble(df, ["station_id", "hour", "x"]))


def predicted(model, rows):
    return [r.p for r in model.transform(rows).orderBy("station_id", "service_date", "hour").select("p").collect()]


def test_a_saved_model_predicts_the_same(spark, rows, scratch):
    model = StackedBoosters("in_nums", ORIGINS, BASES, output_col="p").fit(rows)
    path = os.path.join(scratch, "model")
    model.write().save(path)
    again = StackedBoostersModel.load(path)
    assert predicted(again, rows) == predicted(model, rows)
    assert again.pred_cols == ["pred_l1_d6", "pred_l1_d5"] and again.uid == model.uid
    assert again.getOrDefault("origins") == [str(o) for o in ORIGINS]
    with pytest.raises(Exception, match="already exists"):
        model.write().save(path)
    model.write().overwrite().save(path)


def test_a_saved_estimator_with_another_meta_model(spark, rows, scratch):
    stack = StackedBoosters("in_nums", ORIGINS, BASES, output_col="p", meta=DecisionTreeRegressor(maxDepth=4))
    path = os.path.join(scratch, "stack")
    stack.write().save(path)
    again = StackedBoosters.load(path)
    assert again.bases == list(BASES) and again.meta.getMaxDepth() == 4
    model = again.fit(rows)
    assert predicted(model, rows) == predicted(stack.fit(rows), rows)
    assert type(model.meta).__name__ == "DecisionTreeRegressionModel"
    linear = StackedBoosters("in_nums", ORIGINS, BASES, output_col="p").fit(rows)
    assert predicted(model, rows) != predicted(linear, rows)


def walk(lines, x):
    """A tree's prediction, from its printed form."""
    k = 0
    while True:
        text = lines[k]
        found = re.match(r" *(If|Else) \(feature (\d+) (<=|>) (\S+)\)", text)
        if not found:
            return float(re.search(r"Predict: (\S+)", text)[1])
        indent = len(text) - len(text.lstrip())
        if (x[int(found[2])] <= float(found[4])) == (found[3] == "<="):
            k += 1
        else:  # the Else of this If
            k = next(j for j in range(k + 1, len(lines)) if lines[j].startswith(" " * indent + "Else"))


@pytest.mark.parametrize("spec", [L1_DEPTH6, L1_DEPTH5, L2_DEPTH9], ids=lambda s: s.name)
def test_predictions_are_those_of_the_trees(rows, spec):
    model = with_rounds(spec, 4).estimator("in_nums").fit(rows)
    trees = [t.rstrip().split("\n") for t in re.split(r"\n *Tree \d+ \(weight [^)]*\):\n", model.toDebugString)[1:]]
    assert len(trees) == 4
    for r in model.transform(rows).collect():
        x = r.features.toArray()
        want = sum(w * walk(t, x) for w, t in zip(model.treeWeights, trees))
        assert r.prediction == pytest.approx(want, rel=1e-12, abs=1e-12)
    assert np.isfinite([r.prediction for r in model.transform(rows).collect()]).all()
