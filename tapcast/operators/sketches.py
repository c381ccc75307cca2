"""Distinct devices as mergeable sketches.

``device_sketches`` keeps one HyperLogLog sketch per (station, date, slot). A
stored table of them answers any coarser grain by uniting sketches: neither the
cells nor the taps are read again, and a day that is added later brings its own
sketches only. With 2^12 registers the relative standard error is 1.6 %.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapcast.functions.slots import SLOT_MINUTES, slot_hour

LG_K = 12


def standard_error(lg_k: int = LG_K) -> float:
    """Relative standard error of an estimate."""
    return 1.04 / math.sqrt(2 ** lg_k)


def device_sketches(cells: DataFrame, slot_minutes: int = SLOT_MINUTES, lg_k: int = LG_K) -> DataFrame:
    """(station_id, service_date, hour, slot, devices: sketch) from ``tap_cells``;
    null devices aren't counted."""
    return (cells.groupBy("station_id", "service_date", "slot")
            .agg(F.hll_sketch_agg("device_id", lg_k).alias("devices"))
            .withColumn("hour", slot_hour("slot", slot_minutes)))


def united(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches of a coarser grain."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("devices").alias("devices"))


def with_estimate(sketches: DataFrame) -> DataFrame:
    return sketches.withColumn("estimate", F.hll_sketch_estimate("devices")).drop("devices")
