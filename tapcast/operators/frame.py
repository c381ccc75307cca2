"""Next-day supervised frame.

Features of day d predict the counts of day d+1. The next-day target is
read with a RANGE frame over (station, hour, slot) ordered by day number,
instead of joining the table to itself: one exchange of one side, and a
partition holds at most one row per day. Partitioning by (station, hour,
slot) is implied by (station, hour), the partitioning the weekly profile
already uses, so the frame adds no exchange after the feature stage.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapcast.functions.calendar import (DEFAULT_CALENDAR, Calendar, day_of_month,
                                         is_holiday, iso_weekday)
from tapcast.functions.slots import SLOT_MINUTES, slot_hour, slot_minute
from tapcast.operators.dimension import dimension_join

KEYS = ["station_id", "service_date", "slot"]
# Station-level attributes of the feature day, copied onto template-only
# slots of the same station.
STATIC_COLS = ["weekday", "yesterday_is_holiday", "nuni_device_station",
               "line_size", "station_type", "is_special"]
TARGETS = ["in_nums", "out_nums"]


def _as_date(d):
    return dt.date.fromisoformat(d) if isinstance(d, str) else d


def with_next_day_target(features: DataFrame, in_col: str = "in_now",
                         out_col: str = "out_now") -> DataFrame:
    """``in_nums``/``out_nums``: the same station and slot one day later,
    0 when that slot had no taps."""
    w = (Window.partitionBy("station_id", "hour", "slot")
         .orderBy(F.unix_date("service_date")).rangeBetween(1, 1))
    return features.withColumns({
        "in_nums": F.coalesce(F.sum(in_col).over(w), F.lit(0)).cast("bigint"),
        "out_nums": F.coalesce(F.sum(out_col).over(w), F.lit(0)).cast("bigint"),
    })


def shift_to_target_day(df: DataFrame, calendar: Calendar = DEFAULT_CALENDAR) -> DataFrame:
    """Move the row to the day it predicts: date + 1, that day's weekday and
    day of month; the feature day's holiday flag becomes
    ``yesterday_is_holiday`` and the target day's is ``today_is_holiday``."""
    d = F.date_add("service_date", 1)
    return (df.withColumnRenamed("is_holiday", "yesterday_is_holiday")
            .withColumns({"service_date": d}).withColumns({
                "weekday": iso_weekday("service_date"),
                "day": day_of_month("service_date"),
                "today_is_holiday": is_holiday("service_date", calendar),
            }))


def observed_dates(taps: DataFrame) -> DataFrame:
    """Distinct service dates of taps or ``tap_cells``: one column scanned (the
    partition column when the taps are date-partitioned), aggregated map-side;
    at most one row per day of history."""
    if "service_date" in taps.columns:
        return taps.select("service_date").distinct()
    return taps.select(F.to_date("time").alias("service_date")).distinct()


def train_frame(features: DataFrame, target_date, calendar: Calendar = DEFAULT_CALENDAR,
                in_col: str = "in_now", out_col: str = "out_now",
                observed: DataFrame | None = None) -> DataFrame:
    """Rows whose target day was observed and is not the target date (F1).

    ``observed``: the dates that have taps (``observed_dates(taps)``); taken
    from the features when omitted, which re-runs the feature plan."""
    target_date = _as_date(target_date)
    if observed is None:
        observed = features.select("service_date").distinct()
    if not set(TARGETS) <= set(features.columns):
        features = with_next_day_target(features, in_col, out_col)
    shifted = shift_to_target_day(features, calendar)
    return dimension_join(shifted.where(F.col("service_date") != F.lit(target_date)),
                          observed.select("service_date"), "service_date", "left_semi")


def score_frame(features: DataFrame, grid: DataFrame, target_date,
                calendar: Calendar = DEFAULT_CALENDAR, slot_minutes: int = SLOT_MINUTES,
                static_cols=STATIC_COLS, recompute_peak: bool = False,
                in_col: str = "in_now", out_col: str = "out_now") -> DataFrame:
    """Rows to predict: the last feature day shifted onto the target date,
    full-outer-joined with the target-day grid (J16). Template-only slots
    take the station's static attributes (J17) and 0 for every flow; their
    peak class is 0 unless ``recompute_peak``."""
    target_date = _as_date(target_date)
    feats = shift_to_target_day(
        features.where(F.col("service_date") == F.lit(target_date - dt.timedelta(days=1))),
        calendar)
    feats = feats.withColumns({"in_nums": F.lit(None).cast("bigint"),
                               "out_nums": F.lit(None).cast("bigint")})
    g = grid.where(F.col("service_date") == F.lit(target_date)).select(*KEYS)
    static = [c for c in static_cols if c in feats.columns]
    joined = feats.join(g, KEYS, "full_outer")
    # Static attributes of the station's complete feature rows, spread to
    # every row of that station (template-only slots included). A window
    # over one station's rows of one day replaces a second read of the
    # features for a per-station aggregate.
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in static])
    by_station = Window.partitionBy("station_id")
    joined = joined.withColumns({c: F.max(F.when(complete, F.col(c))).over(by_station)
                                 for c in static})
    joined = joined.withColumns({
        "hour": slot_hour("slot", slot_minutes),
        "minute": slot_minute("slot", slot_minutes),
        "day": day_of_month("service_date"),
        "today_is_holiday": is_holiday("service_date", calendar),
    })
    if recompute_peak and "peak_type" in joined.columns:
        from tapcast.operators.peak import peak_type_col
        joined = joined.withColumn(
            "peak_type", peak_type_col(F.coalesce("yesterday_is_holiday", F.lit(0)), "slot",
                                       slot_minutes=slot_minutes))
    fill = [c for c, t in joined.dtypes if c not in KEYS and t not in ("date", "string")]
    return joined.na.fill(0, subset=fill)


def stage_features(features: DataFrame) -> DataFrame:
    """Features with their next-day targets, written once (``materialize``).

    Train and score rows both derive from the features; staging them keeps
    a union of the two from running the feature plan (and the raw scan)
    twice. The target window runs before the write, inside the partitioning
    the feature plan already has; the score side then reads one day through
    a pushed-down date filter."""
    from tapcast.session import materialize
    return materialize(with_next_day_target(features), sort_within=["service_date"])


def exclude_dates(df: DataFrame, dates) -> DataFrame:
    """drop listed target dates (e.g. the day after New Year)."""
    ds = [_as_date(d) for d in dates]
    return df.where(~F.col("service_date").isin(ds)) if ds else df


def cohort(df: DataFrame, holiday: int = 0, col: str = "today_is_holiday") -> DataFrame:
    """workday-only (0) or holiday-only (1) rows."""
    return df.where(F.col(col) == holiday)


def derived_candidates(cols) -> dict:
    """Name -> expression of the sum, difference and ratio of every two of the
    columns; a ratio by 0 is null."""
    out = {}
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            x, y = F.col(a).cast("double"), F.col(b).cast("double")
            out[f"{a}+{b}"], out[f"{a}-{b}"], out[f"{a}/{b}"] = x + y, x - y, F.try_divide(x, y)
    return out


def feature_screen(frame: DataFrame, cols, targets=("in_nums", "out_nums"), top: int = 10) -> DataFrame:
    """The ``top`` derived candidates of each target by absolute correlation:
    (target, feature, corr, rank). One pass: every correlation is an aggregate
    of sufficient statistics (counts, means, co-moments) that merge map-side; a
    task sends one row. Rows where a candidate is null don't count for it;
    undefined correlations (constant columns) are left out; equal ones, to six
    places, go by name."""
    found = derived_candidates(cols)
    pairs = [(t, name) for t in targets for name in found]
    # Candidates are columns first, so that both targets share them.
    flat = frame.select(*targets, *[c.alias(f"c{i}") for i, c in enumerate(found.values())])
    at = {name: f"c{i}" for i, name in enumerate(found)}

    def corr(c: str, t: str):  # F.corr of a constant column is an error under ANSI rules
        both = F.when(F.col(c).isNotNull(), F.col(t))
        return F.try_divide(F.covar_pop(c, t), F.stddev_pop(c) * F.stddev_pop(both))

    row = flat.agg(*[corr(at[name], t).alias(f"r{i}") for i, (t, name) in enumerate(pairs)])
    listed = row.select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("target"), F.lit(name).alias("feature"), F.col(f"r{i}").alias("corr"))
        for i, (t, name) in enumerate(pairs)])).alias("c")).select("c.*")
    listed = (listed.where(F.col("corr").isNotNull() & ~F.isnan("corr"))
              .withColumn("corr", F.round(F.col("corr") * 1e6) / 1e6 + F.lit(0.0)))
    order = Window.partitionBy("target").orderBy(F.desc(F.abs("corr")), "feature")  # candidates, not rows
    return listed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def add_ratio_features(df: DataFrame) -> DataFrame:
    """Sums, differences and ratios of related flows (NULL on a zero
    denominator)."""
    return df.withColumns({
        "net_now": F.col("in_now") - F.col("out_now"),
        "total_now": F.col("in_now") + F.col("out_now"),
        "in_share_now": F.try_divide(F.col("in_now"), F.col("in_now") + F.col("out_now")),
        "in_trend": F.col("in_after1") - F.col("in_before1"),
        "out_trend": F.col("out_after1") - F.col("out_before1"),
        "in_vs_week": F.try_divide(F.col("in_now").cast("double"), F.col("in_whm_mean")),
        "out_vs_week": F.try_divide(F.col("out_now").cast("double"), F.col("out_whm_mean")),
    })


def frame_columns_for(features: DataFrame) -> list:
    """Supervised-frame column order for a feature frame: keys, calendar,
    feature values, targets, target-day holiday flag."""
    head = ["station_id", "service_date", "slot", "weekday", "is_holiday", "day", "hour", "minute"]
    vals = [c for c in features.columns if c not in head]
    return (["station_id", "service_date", "slot", "weekday", "yesterday_is_holiday", "day",
             "hour", "minute"] + vals + TARGETS + ["today_is_holiday"])
