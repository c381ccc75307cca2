"""Forecast mechanics with predictors that need no training run.

The mean of a station and slot before the origin, and the count of the day
before, go through the same folds, out-of-fold stacking, fold means, blend and
submission as the boosters, so that SQL can check each step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapcast.operators.validation import fold

TARGETS = ("in", "out")


def slot_means(train: DataFrame) -> DataFrame:
    """Mean target of each station and slot: (station_id, slot, in_mean, out_mean)."""
    return train.groupBy("station_id", "slot").agg(*[F.avg(f"{t}_nums").alias(f"{t}_mean") for t in TARGETS])


def base_predictions(train: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with ``<target>_mean`` (0 for an unseen station and slot) and
    ``<target>_last``."""
    out = rows.join(slot_means(train), ["station_id", "slot"], "left")
    return out.withColumns({f"{t}_mean": F.coalesce(f"{t}_mean", F.lit(0.0)) for t in TARGETS}
                           | {f"{t}_last": F.col(f"{t}_now").cast("double") for t in TARGETS})


def fold_mean_blend(rows: DataFrame, score: DataFrame, origins, weight: float) -> DataFrame:
    """Score rows with ``in_pred`` and ``out_pred``: the mean over origins of
    each origin's slot mean, blended ``weight`` to ``1 - weight`` with the day
    before's count."""
    out = score
    for i, o in enumerate(origins):
        means = slot_means(fold(rows, o)[0]).withColumnsRenamed({f"{t}_mean": f"_{t}_{i}" for t in TARGETS})
        out = out.join(means, ["station_id", "slot"], "left")
    preds = {}
    for t in TARGETS:
        mean = sum((F.coalesce(f"_{t}_{i}", F.lit(0.0)) for i in range(len(origins))), F.lit(0.0)) / len(origins)
        preds[f"{t}_pred"] = mean * weight + F.col(f"{t}_now") * (1 - weight)
    return out.withColumns(preds).drop(*[f"_{t}_{i}" for t in TARGETS for i in range(len(origins))])
