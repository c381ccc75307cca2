"""Blend weights learned from out-of-fold predictions (M8).

Weights lie on the simplex (none negative, their sum is 1) and minimise the
mean absolute error. All weight vectors of a step are judged in one aggregation
over the out-of-fold rows; the next step is a finer lattice around the best.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lattice steps, in thousandths; each looks one step of the last around.
STEPS = (100, 20, 4, 1)
#: Weight vectors judged in one aggregation (columns of its single row).
AT_ONCE = 200


def lattice(k: int, step: int, around: tuple[int, ...] | None = None, reach: int = 1000) -> list[tuple[int, ...]]:
    """Whole numbers adding up to 1000: all multiples of ``step``, or those
    whose first ``k - 1`` lie within ``reach`` of ``around``, by ``step``."""
    if around is None:
        axes = [range(0, 1001, step)] * (k - 1)
    else:
        axes = [[x for x in range(c - reach, c + reach + 1, step) if 0 <= x <= 1000] for c in around[:-1]]
    return [(*w, 1000 - sum(w)) for w in product(*axes) if sum(w) <= 1000]


def blended(preds: list[str], weights: tuple[int, ...]) -> Column:
    out = None
    for c, w in zip(preds, weights):
        term = F.lit(w / 1000) * F.col(c)
        out = term if out is None else out + term
    return out


def blend_weights(oof: DataFrame, label: str, preds: list[str], steps: tuple[int, ...] = STEPS) -> tuple[tuple[int, ...], float]:
    """(weights in thousandths, their MAE). Of vectors that are equal to nine
    places the first in order wins. Rows with a null are not judged; without
    rows the weights are equal as far as thousandths go, and the MAE is NaN."""
    rows = oof.select(label, *preds).dropna()
    best: tuple[tuple[int, ...], float] | None = None
    for step, last in zip(steps, (None, *steps[:-1])):
        found = lattice(len(preds), step, None if best is None else best[0], last or 1000)
        judged = []
        for a in range(0, len(found), AT_ONCE):
            part = found[a:a + AT_ONCE]
            row = rows.agg(*[F.avg(F.abs(F.col(label) - blended(preds, w))).alias(f"m{i}") for i, w in enumerate(part)]).first()
            judged += [(round(row[i], 9), w) for i, w in enumerate(part) if row[i] is not None]
        if not judged:
            base = 1000 // len(preds)
            return (base,) * (len(preds) - 1) + (1000 - base * (len(preds) - 1),), float("nan")
        mae, w = min(judged)
        best = (w, mae)
    return best
