"""Base slot table.

One aggregation over raw taps at the (station, date, slot, device) grain
carries the map-side combine, so a station that holds a third of all taps
still ships only its distinct device-slot cells through the shuffle. The
result is then hash-partitioned once by (station, date): every per-day
feature after it (slot totals, distinct devices at three grains, the
neighbour-slot frames) runs inside that partitioning with no further
exchange. A (station, date) group holds at most devices x slots rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapcast.functions.calendar import (DEFAULT_CALENDAR, Calendar, day_of_month,
                                         is_holiday, iso_weekday, service_date)
from tapcast.functions.slots import SLOT_MINUTES, slot_hour, slot_minute, slot_of

KEYS = ["station_id", "service_date", "slot"]


def with_calendar(df: DataFrame, calendar: Calendar = DEFAULT_CALENDAR,
                  slot_minutes: int = SLOT_MINUTES, date_col: str = "service_date") -> DataFrame:
    """weekday, is_holiday, day, hour, minute from a date and a slot column."""
    d = F.col(date_col)
    return df.withColumns({
        "weekday": iso_weekday(d),
        "is_holiday": is_holiday(d, calendar),
        "day": day_of_month(d),
        "hour": slot_hour("slot", slot_minutes),
        "minute": slot_minute("slot", slot_minutes),
    })


def tap_cells(taps: DataFrame, slot_minutes: int = SLOT_MINUTES) -> DataFrame:
    """Taps reduced to one row per (station, date, slot, device, line) with
    tap and entry counts: the only aggregation that touches raw rows. Slots,
    lines and observed dates can all be read from it, so a plan that stages it
    (``materialize``) scans the taps once."""
    return (taps.select("station_id",
                        service_date("time").alias("service_date"),
                        slot_of("time", slot_minutes).alias("slot"),
                        "device_id", "line_id", "status")
            .groupBy("station_id", "service_date", "slot", "device_id", "line_id")
            .agg(F.count("status").alias("n_taps"),
                 F.sum("status").alias("n_in")))


def device_slot_cells(taps: DataFrame, slot_minutes: int = SLOT_MINUTES) -> DataFrame:
    """Taps, or their ``tap_cells``, reduced to one row per (station, date,
    slot, device)."""
    keys = ["station_id", "service_date", "slot", "device_id"]
    if "n_taps" in taps.columns:
        return taps.groupBy(*keys).agg(F.sum("n_taps").alias("n_taps"), F.sum("n_in").alias("n_in"))
    return (taps.select("station_id",
                        service_date("time").alias("service_date"),
                        slot_of("time", slot_minutes).alias("slot"),
                        "device_id", "status")
            .groupBy(*keys)
            .agg(F.count("status").alias("n_taps"),
                 F.sum("status").alias("n_in")))


def slot_table(taps: DataFrame, calendar: Calendar = DEFAULT_CALENDAR,
               slot_minutes: int = SLOT_MINUTES, with_devices: bool = True,
               partitions: int | None = None) -> DataFrame:
    """One row per non-empty (station, date, slot).

    Columns: station_id, service_date, slot, weekday, is_holiday, day, hour,
    minute, in_nums, out_nums and, with ``with_devices``, the distinct device
    counts per station-day, station-hour and station-slot. ``taps`` may be
    their ``tap_cells`` of the same slot width.
    """
    if not with_devices and "n_taps" in taps.columns:
        slots = taps.groupBy(*KEYS).agg(F.sum("n_taps").alias("n_taps"), F.sum("n_in").alias("n_in"))
    elif not with_devices:
        # Counts only: one aggregation with map-side combine, no device grain.
        slots = (taps.select("station_id", service_date("time").alias("service_date"),
                             slot_of("time", slot_minutes).alias("slot"), "status")
                 .groupBy("station_id", "service_date", "slot")
                 .agg(F.count("status").alias("n_taps"), F.sum("status").alias("n_in")))
    else:
        slots = _slots_with_devices(taps, slot_minutes, partitions)
    in_nums = F.coalesce(F.col("n_in"), F.lit(0)).cast("bigint")
    slots = slots.withColumns({
        "in_nums": in_nums,
        "out_nums": (F.col("n_taps") - in_nums).cast("bigint"),
    }).drop("d_first", "h_first", "n_taps", "n_in")
    slots = with_calendar(slots, calendar, slot_minutes)
    cols = KEYS + ["weekday", "is_holiday", "day", "hour", "minute", "in_nums", "out_nums"]
    if with_devices:
        cols += ["nuni_device_station", "nuni_device_station_hour", "nuni_device_station_slot"]
    return slots.select(*cols)


def _slots_with_devices(taps: DataFrame, slot_minutes: int, partitions: int | None) -> DataFrame:
    """Slot totals plus distinct devices per station-day, -hour and -slot."""
    def by_day(df: DataFrame) -> DataFrame:
        return (df.repartition(partitions, "station_id", "service_date") if partitions
                else df.repartition("station_id", "service_date"))

    # Cells are combined inside the per-day partitioning; raw taps first
    # (map-side), so that a hot station ships its cells only.
    if "n_taps" in taps.columns:
        cells = device_slot_cells(by_day(taps), slot_minutes)
    else:
        cells = by_day(device_slot_cells(taps, slot_minutes))
    cells = cells.withColumn("hour", slot_hour("slot", slot_minutes))
    # A device's first cell of the day / of an hour marks one distinct
    # device; summing the marks over windows replaces count(distinct),
    # which windows do not support. One sort order serves both marks.
    known = F.col("device_id").isNotNull()
    by_dev = Window.partitionBy("station_id", "service_date", "device_id").orderBy("slot")
    prev_hour = F.lag("hour").over(by_dev)
    cells = cells.withColumns({
        "first_day": (known & (F.row_number().over(by_dev) == 1)).cast("int"),
        "first_hour": (known & (prev_hour.isNull() | (prev_hour != F.col("hour")))).cast("int"),
    })
    slots = (cells.groupBy("station_id", "service_date", "slot", "hour")
             .agg(F.sum("n_taps").alias("n_taps"),
                  F.sum("n_in").alias("n_in"),
                  F.count("device_id").alias("nuni_device_station_slot"),
                  F.sum("first_day").alias("d_first"),
                  F.sum("first_hour").alias("h_first")))
    return slots.withColumns(_day_and_hour_totals(slot_minutes))


def _day_and_hour_totals(slot_minutes: int) -> dict:
    """Station-day and station-hour sums of the first-appearance marks.

    The window is (station, date) ordered by slot -- the same spec as the
    neighbour-slot frames -- so the sort is shared. When slots tile the hour,
    the hour total of slot s is a RANGE frame from the hour's first slot to
    its last, i.e. offsets (-k, n-1-k) with k = s mod n slots per hour; one
    frame per k, chosen by a CASE."""
    w = Window.partitionBy("station_id", "service_date").orderBy("slot")
    day = F.sum("d_first").over(w.rowsBetween(Window.unboundedPreceding,
                                              Window.unboundedFollowing))
    if 60 % slot_minutes == 0:
        n = 60 // slot_minutes
        k = F.col("slot") % n
        hour = None
        for i in range(n):
            frame = F.sum("h_first").over(w.rangeBetween(-i, n - 1 - i))
            hour = F.when(k == i, frame) if hour is None else hour.when(k == i, frame)
    else:
        # Slots that straddle hours: a window per (station, date, hour).
        hour = F.sum("h_first").over(Window.partitionBy("station_id", "service_date", "hour"))
    return {"nuni_device_station": day, "nuni_device_station_hour": hour}
