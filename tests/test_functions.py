import datetime as dt

from pyspark.sql import functions as F

from tapcast.functions.calendar import (Calendar, is_holiday, iso_weekday, month_day_key,
                                         rotate_weekday)
from tapcast.functions.slots import clock_slot, clock_to_slot, slot_hour, slot_minute, slot_of


def test_weekday_and_holiday_exceptions(spark):
    days = [dt.date(2019, 1, 1), dt.date(2019, 1, 5), dt.date(2019, 1, 7), dt.date(2019, 2, 2),
            dt.date(2019, 2, 4), dt.date(2019, 10, 12), dt.date(2024, 1, 31), dt.date(2019, 10, 7)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    out = {r.d: r for r in df.select(
        "d", iso_weekday("d").alias("w"), is_holiday("d").alias("h"),
        month_day_key("d").alias("md")).collect()}
    assert out[dt.date(2019, 1, 1)].h == 1        # listed holiday on a Tuesday
    assert out[dt.date(2019, 1, 5)].h == 1        # Saturday
    assert out[dt.date(2019, 1, 7)].h == 0        # Monday
    assert out[dt.date(2019, 2, 2)].h == 0        # Saturday worked
    assert out[dt.date(2019, 2, 4)].h == 1        # Monday holiday
    assert out[dt.date(2019, 10, 12)].h == 0      # Saturday worked
    assert out[dt.date(2024, 1, 31)].w == 3 and out[dt.date(2024, 1, 31)].h == 0
    assert out[dt.date(2019, 1, 7)].w == 1 and out[dt.date(2019, 1, 5)].w == 6
    assert out[dt.date(2019, 10, 7)].md == "10-7"


def test_calendar_with_year_specific_entry(spark):
    cal = Calendar(holidays=("2024-1-3",), workdays=("2024-1-6",))
    df = spark.createDataFrame([(dt.date(2024, 1, 3),), (dt.date(2025, 1, 3),),
                                (dt.date(2024, 1, 6),)], "d date")
    got = {r.d: r.h for r in df.select("d", is_holiday("d", cal).alias("h")).collect()}
    assert got == {dt.date(2024, 1, 3): 1, dt.date(2025, 1, 3): 0, dt.date(2024, 1, 6): 0}


def test_rotate_weekday(spark):
    df = spark.range(1, 8).select(F.col("id").cast("int").alias("w"))
    got = [r.r for r in df.select(rotate_weekday("w").alias("r")).orderBy("w").collect()]
    assert got == [2, 3, 4, 5, 6, 7, 1]


def test_slot_functions(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 7, 39, 59),),
                                (dt.datetime(2024, 1, 1, 23, 59, 59),),
                                (dt.datetime(2024, 1, 1, 0, 0, 0),)], "t timestamp_ntz")
    got = df.select(slot_of("t").alias("s"), slot_of("t", 60).alias("h")).collect()
    assert [(r.s, r.h) for r in got] == [(45, 7), (143, 23), (0, 0)]
    hm = spark.createDataFrame([(45,), (143,)], "s int").select(
        slot_hour("s").alias("h"), slot_minute("s").alias("m")).collect()
    assert [(r.h, r.m) for r in hm] == [(7, 30), (23, 50)]
    c = spark.createDataFrame([("7:30",), ("18:00",), ("0:00",)], "c string")
    assert [r.s for r in c.select(clock_to_slot("c").alias("s")).collect()] == [45, 108, 0]
    assert clock_slot("17:30") == 105 and clock_slot("9:00", 60) == 9
