"""Peak class per slot.

0 = closed, 1 = normal, 2 = peak, 3 = special peak. Slots may be wider than
the periods' bounds (see ``slot_ranges``). The periods are a fixed literal
parameter, so the lookup is a CASE expression over slot ranges
(pure projection, no join); ``peak_table`` gives the same mapping as an
inline DataFrame for callers that want to join it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapcast.functions.slots import SLOT_MINUTES, clock_minutes, slots_per_day

# Operating periods as (start clock, end clock, class), end
# exclusive, for workdays (is_holiday = 0) and holidays (is_holiday = 1).
# Slots not covered are class 1.
WORKDAY_PERIODS = [
    ("0:00", "6:00", 0),
    ("7:00", "7:30", 2), ("8:30", "9:00", 2), ("17:00", "17:30", 2), ("18:30", "19:00", 2),
    ("7:30", "8:30", 3), ("17:30", "18:30", 3),
]
HOLIDAY_PERIODS = [
    ("0:00", "6:00", 0),
    ("7:00", "9:00", 2), ("12:00", "15:00", 2), ("18:00", "20:00", 2),
    ("9:00", "12:00", 3), ("15:00", "18:00", 3),
]
PEAK_PERIODS = {0: WORKDAY_PERIODS, 1: HOLIDAY_PERIODS}
DEFAULT_PEAK = 1


def slot_ranges(periods=None, slot_minutes: int = SLOT_MINUTES):
    """(is_holiday, first_slot, end_slot, class) with slot bounds, default
    class left out. A slot that several periods share has the class that
    covers most of its minutes, of equal ones the higher; minutes outside all
    periods count for the default class."""
    periods = PEAK_PERIODS if periods is None else periods
    out = []
    for hol, rows in periods.items():
        minutes = [DEFAULT_PEAK] * 1440
        for start, end, cls in rows:
            for m in range(clock_minutes(start), clock_minutes(end)):
                minutes[m] = cls
        classes = []
        for a in range(0, 1440, slot_minutes):
            part = minutes[a:a + slot_minutes]
            classes.append(max(set(part), key=lambda c: (part.count(c), c)))
        lo = 0
        for s in range(1, len(classes) + 1):
            if s == len(classes) or classes[s] != classes[lo]:
                if classes[lo] != DEFAULT_PEAK:
                    out.append((hol, lo, s, classes[lo]))
                lo = s
    return out


def peak_type_col(is_holiday="is_holiday", slot="slot", periods=None,
                  slot_minutes: int = SLOT_MINUTES) -> Column:
    hol = F.col(is_holiday) if isinstance(is_holiday, str) else is_holiday
    s = F.col(slot) if isinstance(slot, str) else slot
    expr = None
    for h, lo, hi, cls in slot_ranges(periods, slot_minutes):
        cond = (hol == h) & (s >= lo) & (s < hi)
        expr = F.when(cond, cls) if expr is None else expr.when(cond, cls)
    if expr is None:
        return F.lit(DEFAULT_PEAK)
    return expr.otherwise(DEFAULT_PEAK).cast("int")


def add_peak_type(df: DataFrame, periods=None, slot_minutes: int = SLOT_MINUTES) -> DataFrame:
    return df.withColumn("peak_type", peak_type_col("is_holiday", "slot", periods, slot_minutes))


def peak_table(spark: SparkSession, periods=None, slot_minutes: int = SLOT_MINUTES) -> DataFrame:
    """Inline (is_holiday, slot, peak_type) rows for the listed periods:
    2 x slots-per-day rows at most."""
    schema = T.StructType([T.StructField("is_holiday", T.IntegerType()),
                           T.StructField("lo", T.IntegerType()),
                           T.StructField("hi", T.IntegerType()),
                           T.StructField("peak_type", T.IntegerType())])
    rows = slot_ranges(periods, slot_minutes)
    n = slots_per_day(slot_minutes)
    return (spark.createDataFrame(rows, schema)
            .select("is_holiday", F.explode(F.sequence("lo", F.least(F.col("hi") - 1, F.lit(n - 1))))
                    .alias("slot"), "peak_type"))


def add_peak_type_by_join(df: DataFrame, table: DataFrame) -> DataFrame:
    """Equi-join form of the lookup; the table has a fixed bound (2 x slots)."""
    return (df.join(F.broadcast(table), ["is_holiday", "slot"], "left")
            .withColumn("peak_type", F.coalesce("peak_type", F.lit(DEFAULT_PEAK)).cast("int")))
