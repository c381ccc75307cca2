"""Slot grid and submission template."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapcast.functions.slots import SLOT_MINUTES, slot_of, slots_per_day
from tapcast.sources.schema import TEMPLATE_CSV, TIME_FORMAT


def slot_grid(stations: DataFrame, target_date, slot_minutes: int = SLOT_MINUTES,
              station_col: str = "station_id") -> DataFrame:
    """Every (station, slot) of one day: a generator per station row, no join."""
    if isinstance(target_date, str):
        target_date = dt.date.fromisoformat(target_date)
    n = slots_per_day(slot_minutes)
    return (stations.select(F.col(station_col).cast("int").alias("station_id")).distinct()
            .select("station_id",
                    F.lit(target_date).alias("service_date"),
                    F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot")))


def slot_grid_history(slots: DataFrame, slot_minutes: int = SLOT_MINUTES,
                      values=("in_nums", "out_nums")) -> DataFrame:
    """Every slot of every station from its first observed day to its last:
    (station_id, service_date, slot, values, observed). Slots without taps have
    0 and ``observed`` false.

    Each row is stretched to the station's next one (``lead``), the first back
    to its day's start and the last to its day's end; the stretch is exploded.
    No product of stations and slots, and one window per station over rows that
    a slot table already has; a station's rows are its days times slots.
    ``slots`` has one row per (station, date, slot)."""
    n = slots_per_day(slot_minutes)
    day = F.datediff("service_date", F.lit("1970-01-01").cast("date"))
    at = F.col("_day") * n + F.col("slot")
    by = Window.partitionBy("station_id").orderBy("_at")
    rows = (slots.select("station_id", "service_date", "slot", *values).withColumn("_day", day).withColumn("_at", at)
            .withColumn("_from", F.when(F.lag("_at").over(by).isNull(), F.col("_day") * n).otherwise(F.col("_at")))
            .withColumn("_to", F.coalesce(F.lead("_at").over(by), (F.col("_day") + 1) * n) - 1)
            .withColumn("_t", F.explode(F.sequence("_from", "_to"))))
    here = F.col("_t") == F.col("_at")
    return rows.select(
        "station_id", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("_t") / n).cast("int")).alias("service_date"),
        F.pmod(F.col("_t"), F.lit(n)).cast("int").alias("slot"),
        *[F.when(here, F.col(c)).otherwise(F.lit(0)).alias(c) for c in values], here.alias("observed"))


def read_template_csv(spark: SparkSession, path: str,
                      slot_minutes: int = SLOT_MINUTES) -> DataFrame:
    """Target-day template file -> (station_id, service_date, slot)."""
    raw = spark.read.schema(TEMPLATE_CSV).option("header", True).csv(path)
    start = F.to_timestamp_ntz(F.col("startTime"), F.lit(TIME_FORMAT))
    return raw.select(F.col("stationID").alias("station_id"),
                      F.to_date(start).alias("service_date"),
                      slot_of(start, slot_minutes).alias("slot"))
