"""Submission sink (S6, M10): keyed join of predictions onto the grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapcast.functions.slots import SLOT_MINUTES


def submission(grid: DataFrame, predictions: DataFrame, in_col: str = "in_pred",
               out_col: str = "out_pred", slot_minutes: int = SLOT_MINUTES) -> DataFrame:
    """One row per grid cell with ``startTime``/``endTime`` text and the two
    predictions, matched by key (never by position). A cell without a
    prediction stays null; ``write_submission`` refuses it."""
    keys = ["station_id", "service_date", "slot"]
    p = predictions.select(*keys, F.col(in_col).alias("inNums"), F.col(out_col).alias("outNums"))
    start = F.timestamp_add("MINUTE", F.col("slot") * slot_minutes,
                            F.col("service_date").cast("timestamp_ntz"))
    end = F.timestamp_add("MINUTE", F.lit(slot_minutes), start)
    fmt = "yyyy-MM-dd HH:mm:ss"
    return (grid.select(*keys).join(p, keys, "left")
            .select(F.col("station_id").alias("stationID"),
                    F.date_format(start, fmt).alias("startTime"),
                    F.date_format(end, fmt).alias("endTime"),
                    "inNums", "outNums"))


def write_submission(sub: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header, in the order of station and time over all files. A
    cell without a prediction stops the write."""
    def given(c: str):
        lost = F.raise_error(F.concat(F.lit(f"no {c} for station "), F.col("stationID").cast("string"),
                                      F.lit(" at "), F.col("startTime")))
        return F.when(F.col(c).isNull(), lost.cast("double")).otherwise(F.col(c)).alias(c)

    (sub.select("stationID", "startTime", "endTime", given("inNums"), given("outNums"))
        .orderBy("stationID", "startTime")
        .write.mode(mode).option("header", True).csv(path))
