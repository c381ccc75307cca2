"""Feature stage (entry 1 up to the supervised frame) as one lazy plan.

Exchanges on the big side: (1) the device-slot aggregation with map-side
combine, (2) (station, date) for the per-day features, (3) (station, hour)
for the weekly profile and the next-day target. Station attributes are one
row per station and join without moving the slot rows when Spark sees they
are small. Given staged ``tap_cells`` instead of taps, (1) has been done and
everything, lines included, is read from them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapcast.functions.calendar import DEFAULT_CALENDAR, Calendar
from tapcast.functions.slots import SLOT_MINUTES
from tapcast.operators.base import slot_table
from tapcast.operators.frame import frame_columns_for
from tapcast.operators.neighbors import add_neighbor_slots
from tapcast.operators.network import (add_station_attributes, line_size, station_attributes,
                                       station_lines)
from tapcast.operators.peak import add_peak_type
from tapcast.operators.seasonal import add_week_flow, add_week_flow_asof

FEATURE_COLS = [
    "station_id", "service_date", "slot", "weekday", "is_holiday", "day", "hour", "minute",
    "in_now", "out_now",
    "nuni_device_station", "nuni_device_station_hour", "nuni_device_station_slot",
    "in_before2", "out_before2", "in_before1", "out_before1",
    "in_after2", "out_after2", "in_after1", "out_after1",
    "peak_type",
    "in_whm_max", "in_whm_min", "in_whm_mean", "out_whm_max", "out_whm_min", "out_whm_mean",
    "in_wh_max", "in_wh_min", "in_wh_mean", "out_wh_mean",
    "line_size", "station_type", "is_special",
]


@dataclass
class FeatureConfig:
    calendar: Calendar = DEFAULT_CALENDAR
    slot_minutes: int = SLOT_MINUTES
    special_ids: tuple = (15,)
    lags: tuple = (1, 2)
    leads: tuple = (1, 2)
    peak_periods: dict | None = None
    week_flow_before: object = None
    week_flow_asof: bool = False
    partitions: int | None = None
    extra: dict = field(default_factory=dict)


def slot_features(taps: DataFrame, degrees: DataFrame, cfg: FeatureConfig = FeatureConfig(),
                  lines: DataFrame | None = None, with_attributes: bool = True) -> DataFrame:
    """Taps, or their ``tap_cells``, -> one feature row per non-empty (station,
    date, slot). ``with_attributes=False`` leaves the station attributes out."""
    base = slot_table(taps, cfg.calendar, cfg.slot_minutes, partitions=cfg.partitions)
    f = add_neighbor_slots(base, cfg.lags, cfg.leads)
    f = add_peak_type(f, cfg.peak_periods, cfg.slot_minutes)
    f = (f.repartition(cfg.partitions, "station_id", "hour") if cfg.partitions
         else f.repartition("station_id", "hour"))
    f = add_week_flow_asof(f) if cfg.week_flow_asof else add_week_flow(f, before=cfg.week_flow_before)
    if not with_attributes:
        return f
    sizes = line_size(lines if lines is not None else station_lines(taps))
    attrs = station_attributes(sizes, degrees, cfg.special_ids)
    f = add_station_attributes(f, attrs, cfg.special_ids)
    cols = [c for c in FEATURE_COLS if c in f.columns]
    return f.select(*cols, *[c for c in f.columns if c not in cols])


def frame_columns(features: DataFrame) -> list:
    return frame_columns_for(features)


def round_double(c, digits: int = 6):
    """Round half away from zero on the binary value: ``round(x * 10^d) / 10^d``.

    Spark's ``round(x, d)`` rounds the shortest decimal text of ``x``, so a
    value printed as ``...5`` in the 7th place can round differently from an
    engine that rounds the binary value; scaling first makes both agree."""
    scale = float(10 ** digits)
    col = F.col(c) if isinstance(c, str) else c
    # ``+ 0.0`` turns -0.0 into 0.0, so equal values also print the same.
    return F.round(col * scale, 0) / scale + F.lit(0.0)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (for order-insensitive comparisons)."""
    return df.select(*[round_double(c, digits).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])
