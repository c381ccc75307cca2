"""Incremental form of the daily scan + slot aggregation.

Daily tap files land in a folder; a file-source stream turns each new file
into slot counts. Event time is the tap time, a watermark bounds the state,
and a slot's counts are emitted once the watermark passes its end. Taps that
arrive later than ``lateness`` are dropped by the watermark; files that may come
days late belong to ``sources.ledger``, which recomputes the dates they touch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapcast.functions.slots import SLOT_MINUTES, slot_of
from tapcast.sources.schema import RAW_TAP_CSV, TIME_FORMAT


def tap_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Taps of arriving files. Text that does not parse stops the stream (ANSI
    casts), as ``read_taps_csv`` does."""
    raw = (spark.readStream.schema(RAW_TAP_CSV).option("header", True)
           .option("pathGlobFilter", "*.csv")
           .option("maxFilesPerTrigger", max_files_per_trigger).csv(path))
    return (raw.select(F.to_timestamp(F.col("time"), TIME_FORMAT).alias("time"),
                       F.col("stationID").cast("int").alias("station_id"),
                       F.col("status").cast("int").alias("status"))
            .where(F.col("time").isNotNull() & F.col("station_id").isNotNull()))


def slot_counts_stream(taps: DataFrame, slot_minutes: int = SLOT_MINUTES,
                       lateness: str = "30 minutes") -> DataFrame:
    """Append-mode slot counts: (station_id, service_date, slot, in_nums,
    out_nums) per closed event-time window."""
    w = F.window("time", f"{slot_minutes} minutes")
    agg = (taps.withWatermark("time", lateness)
           .groupBy("station_id", w.alias("w"))
           .agg(F.count("status").alias("n"), F.sum("status").alias("s")))
    start = F.col("w.start")
    ins = F.coalesce("s", F.lit(0)).cast("bigint")
    return agg.select("station_id", F.to_date(start).alias("service_date"),
                      slot_of(start, slot_minutes).alias("slot"),
                      ins.alias("in_nums"), (F.col("n") - ins).cast("bigint").alias("out_nums"))


def start_slot_sink(counts: DataFrame, path: str, checkpoint: str,
                    trigger_seconds: int | None = None):
    """Append closed slots to date-partitioned Parquet. The file sink with a
    checkpoint location is exactly-once: a restarted query resumes from the
    checkpoint and never duplicates a slot."""
    w = (counts.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint).partitionBy("service_date"))
    if trigger_seconds:
        w = w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start(path)
