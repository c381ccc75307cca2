import datetime as dt

from pyspark.sql import types as T

TAP_SCHEMA = T.StructType([
    T.StructField("time", T.TimestampNTZType()),
    T.StructField("line_id", T.StringType()),
    T.StructField("station_id", T.IntegerType()),
    T.StructField("device_id", T.IntegerType()),
    T.StructField("status", T.IntegerType()),
])


def ts(day, hh, mm, ss=0, month=1, year=2024):
    return dt.datetime(year, month, day, hh, mm, ss)


def taps_df(spark, rows):
    """rows: (datetime, line, station, device, status)."""
    return spark.createDataFrame(rows, TAP_SCHEMA)


def by_key(rows, *keys):
    return {tuple(r[k] for k in keys): r for r in rows}
