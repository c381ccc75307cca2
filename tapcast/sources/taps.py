"""Tap sources (S1-S3): daily CSV files, date-partitioned Parquet, and the
fixture adapter that reads taps out of the ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapcast.functions.calendar import service_date
from tapcast.sources.schema import RAW_TAP_CSV, TIME_FORMAT

TAP_COLUMNS = ["time", "line_id", "station_id", "device_id", "status"]


def _clean(df: DataFrame) -> DataFrame:
    # Rows without a station or a time cannot be grouped (pandas drops
    # NaN group keys); filter them at the source.
    return df.where(F.col("time").isNotNull() & F.col("station_id").isNotNull())


def _raw_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return (spark.read.schema(RAW_TAP_CSV).option("header", True)
            .option("pathGlobFilter", "*.csv").csv(path))


#: Raw text column -> its value; a device is any text.
_PARSED = {
    "time": lambda: F.try_to_timestamp(F.col("time"), F.lit(TIME_FORMAT)).cast("timestamp_ntz"),
    "stationID": lambda: F.col("stationID").try_cast("int"),
    "status": lambda: F.col("status").try_cast("int"),
}


def rejected_taps_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows that hold text where a time, station or status does not parse,
    with the name of the first such column."""
    raw = _raw_csv(spark, path)
    reason = F.coalesce(*[F.when(F.col(c).isNotNull() & p().isNull(), F.lit(c)) for c, p in _PARSED.items()])
    return raw.withColumn("reason", reason).where(F.col("reason").isNotNull())


def read_taps_csv(spark: SparkSession, path: str | list[str], bad: str = "raise",
                  file_col: str | None = None) -> DataFrame:
    """All daily tap files under ``path`` in one scan (no per-file loop);
    ``file_col`` adds each row's file.

    Text that does not parse as a time, station or status stops the read
    (``bad="raise"``) or leaves its row to ``rejected_taps_csv``
    (``bad="reject"``). Rows without a time or station are dropped, as null
    group keys are."""
    if bad not in ("raise", "reject"):
        raise ValueError("bad must be 'raise' or 'reject'")
    raw, wrong, parsed = _raw_csv(spark, path), F.lit(False), {}
    for c, parse in _PARSED.items():
        failed = F.col(c).isNotNull() & parse().isNull()
        if bad == "raise":
            error = F.raise_error(F.concat(F.lit(f"unreadable {c}: "), F.col(c)))
            parsed[c] = F.when(failed, error.cast("int" if c != "time" else "timestamp_ntz")).otherwise(parse())
        else:
            wrong, parsed[c] = wrong | failed, parse()
    return _clean(raw.where(~wrong).select(
        parsed["time"].alias("time"), F.col("lineID").alias("line_id"),
        parsed["stationID"].alias("station_id"), F.col("deviceID").alias("device_id"),
        parsed["status"].alias("status"), *([F.col("_metadata.file_path").alias(file_col)] if file_col else [])))


def write_taps_csv(taps: DataFrame, path: str, mode: str = "append") -> None:
    """Daily tap files, as ``read_taps_csv`` reads them: one folder a day."""
    (taps.select(F.date_format("time", TIME_FORMAT).alias("time"), F.col("line_id").alias("lineID"),
                 F.col("station_id").alias("stationID"), F.col("device_id").alias("deviceID"), "status",
                 F.lit(None).cast("string").alias("userID"), F.lit(None).cast("string").alias("payType"),
                 service_date("time").alias("day"))
     .repartition("day").write.mode(mode).option("header", True).partitionBy("day").csv(path))


def write_taps_parquet(taps: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store taps partitioned by service date, so date filters prune files."""
    (taps.withColumn("service_date", service_date("time"))
         .write.mode(mode).partitionBy("service_date").parquet(path))


def read_taps_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Taps written by ``write_taps_parquet``; the ``service_date`` partition
    column is kept, so date filters prune directories and date-only
    questions (observed days, first day) need no timestamp column."""
    df = spark.read.parquet(path)
    cols = TAP_COLUMNS + (["service_date"] if "service_date" in df.columns else [])
    return _clean(df.select(*cols))


def taps_from_events(events: DataFrame, nation: DataFrame, region: DataFrame,
                     n_stations: int = 25) -> DataFrame:
    """Fixture binding of the driver tables to the tap schema.

    station = user_id mod n_stations (= n_nationkey), line = region name of
    that nation, device = ``props.k``, status 1 for click/purchase.
    ``nation`` (25 rows) and ``region`` (5 rows) have a fixed size by the
    TPC-H definition, so broadcasting them is safe at any scale factor.
    """
    station = (F.col("user_id") % n_stations).cast("int")
    taps = events.select(
        F.col("ts").alias("time"),
        station.alias("station_id"),
        F.get_json_object("props", "$.k").cast("int").alias("device_id"),
        F.when(F.col("event_type").isin("click", "purchase"), 1).otherwise(0).alias("status"),
    )
    lines = (nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey, "left")
             .select(F.col("n_nationkey").alias("station_id"), F.col("r_name").alias("line_id")))
    taps = taps.join(F.broadcast(lines), "station_id", "left")
    return _clean(taps.select(*TAP_COLUMNS))
