"""Rolling-origin validation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _as_date(d):
    return dt.date.fromisoformat(d) if isinstance(d, str) else d


def fold(frame: DataFrame, origin, date_col: str = "service_date"):
    """(train, valid): rows before the origin day, rows of the origin day."""
    o = F.lit(_as_date(origin))
    return frame.where(F.col(date_col) < o), frame.where(F.col(date_col) == o)


def same_weekday_origins(target_date, k: int = 2, step_weeks: int = 1,
                         first_available=None) -> list:
    """The k dates 1..k weeks before the target (same weekday), oldest first."""
    t = _as_date(target_date)
    out = [t - dt.timedelta(weeks=step_weeks * i) for i in range(k, 0, -1)]
    if first_available is not None:
        out = [d for d in out if d > _as_date(first_available)]
    return out


def fold_sizes(frame: DataFrame, origins, date_col: str = "service_date") -> DataFrame:
    """One row per origin: train rows, valid rows and the train date span.

    Rows are first counted per date; one aggregation over those counts
    serves every origin, and its single row is exploded into one row per
    origin."""
    per_date = frame.groupBy(date_col).agg(F.count(F.lit(1)).alias("_rows"))
    d, aggs, rows = F.col(date_col), [], []
    for i, o in enumerate(origins):
        o = F.lit(_as_date(o))
        aggs += [F.coalesce(F.sum(F.when(d < o, F.col("_rows"))), F.lit(0)).alias(f"t{i}"),
                 F.coalesce(F.sum(F.when(d == o, F.col("_rows"))), F.lit(0)).alias(f"v{i}"),
                 F.min(F.when(d < o, d)).alias(f"f{i}"),
                 F.max(F.when(d < o, d)).alias(f"l{i}")]
        rows.append(F.struct(o.alias("origin"), F.col(f"t{i}").alias("n_train"),
                             F.col(f"v{i}").alias("n_valid"),
                             F.col(f"f{i}").alias("first_train_date"),
                             F.col(f"l{i}").alias("last_train_date")))
    return per_date.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def out_of_fold(frame: DataFrame, origins, fit_predict, keys=("station_id", "service_date", "slot"),
                date_col: str = "service_date") -> DataFrame:
    """V4: for every origin, fit on the rows before it and predict its rows;
    the predictions of all origins stacked by name and keyed by ``keys``.
    ``fit_predict(train, valid) -> valid with prediction columns``."""
    parts = []
    for o in origins:
        tr, va = fold(frame, o, date_col)
        parts.append(fit_predict(tr, va))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
