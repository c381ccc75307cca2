"""Exact quantiles by counting passes.

``percentile`` merges all distinct values in one task. Here a pass counts the
values of a range in ``BINS`` equal bins, with each bin's least and greatest
value; the bin that holds the sought rank is the next range, until it holds one
value. Every pass is an aggregation with map-side combine, so a task sends at
most ``BINS`` rows, whatever the number of values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1024


def _weight(col: str | None) -> Column:
    return F.lit(1).cast("long") if col is None else F.col(col).cast("long")


def value_at(df: DataFrame, col: str, rank: int, weight: str | None = None) -> tuple[float, int]:
    """The value at a rank (from 0) in ascending order, each row standing for
    ``weight`` equal ones; and how many values are not above it. Infinities
    sort at the ends; there are no nulls and no NaN."""
    v, w = F.col(col).cast("double"), _weight(weight)
    inf = float("inf")
    finite = df.where((v > -inf) & (v < inf))
    edge = df.agg(F.sum(F.when(v == -inf, w)).alias("low"), F.sum(F.when((v > -inf) & (v < inf), w)).alias("mid"),
                  F.sum(w).alias("all"), F.min(F.when(v > -inf, v)).alias("a"),
                  F.max(F.when(v < inf, v)).alias("b")).first()
    below, mid = int(edge["low"] or 0), int(edge["mid"] or 0)
    if not 0 <= rank < int(edge["all"] or 0):
        raise ValueError("no such rank")
    if rank < below:
        return -inf, below
    if rank >= below + mid:
        return inf, int(edge["all"])
    a, b = edge["a"], edge["b"]
    while True:
        # Halves keep the width finite; the least value is in the first bin
        # and the greatest in the last, so every pass narrows the range.
        part = (v / 2 - a / 2) / (b / 2 - a / 2) * BINS if b / 2 > a / 2 else F.when(v > a, F.lit(BINS)).otherwise(0)
        bin_ = F.least(F.floor(part).cast("int"), F.lit(BINS - 1)).alias("bin")
        rows = sorted(finite.where((v >= a) & (v <= b)).groupBy(bin_)
                      .agg(F.sum(w).alias("n"), F.min(v).alias("a"), F.max(v).alias("b")).toLocalIterator(),
                      key=lambda r: r["bin"])  # at most BINS rows
        for r in rows:
            if rank < below + r["n"]:
                break
            below += r["n"]
        a, b = r["a"], r["b"]
        if a == b:
            return a, below + r["n"]


def exact_median(df: DataFrame, col: str, weight: str | None = None) -> float | None:
    """Median of ``col``, rows weighted by whole numbers: the middle value, or
    the mean of the middle two; None of no rows."""
    total = int(df.agg(F.sum(_weight(weight))).first()[0] or 0)
    if not total:
        return None
    low, until = value_at(df, col, (total - 1) // 2, weight)
    if total % 2 or until > total // 2:
        return low
    high = df.where(F.col(col) > low).agg(F.min(col)).first()[0]
    return 0.5 * low + 0.5 * high
