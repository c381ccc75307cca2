from pyspark.sql import functions as F

from tapcast.operators.peak import add_peak_type, add_peak_type_by_join, peak_table

WORKDAY = {35: 0, 36: 1, 41: 1, 42: 2, 44: 2, 45: 3, 50: 3, 51: 2, 53: 2, 54: 1,
           101: 1, 102: 2, 104: 2, 105: 3, 110: 3, 111: 2, 113: 2, 114: 1, 0: 0, 143: 1}
HOLIDAY = {35: 0, 36: 1, 41: 1, 42: 2, 53: 2, 54: 3, 71: 3, 72: 2, 89: 2, 90: 3, 107: 3,
           108: 2, 119: 2, 120: 1, 143: 1}


def _grid(spark):
    return spark.range(0, 144).select(F.col("id").cast("int").alias("slot")).crossJoin(
        spark.createDataFrame([(0,), (1,)], "is_holiday int"))


def test_peak_edges(spark):
    got = {(r.is_holiday, r.slot): r.peak_type for r in add_peak_type(_grid(spark)).collect()}
    for s, c in WORKDAY.items():
        assert got[(0, s)] == c, (0, s)
    for s, c in HOLIDAY.items():
        assert got[(1, s)] == c, (1, s)


def test_case_equals_table_join(spark):
    g = _grid(spark)
    a = add_peak_type(g).orderBy("is_holiday", "slot").collect()
    b = add_peak_type_by_join(g, peak_table(spark)).select("slot", "is_holiday", "peak_type") \
        .orderBy("is_holiday", "slot").collect()
    assert [(r.is_holiday, r.slot, r.peak_type) for r in a] == \
           [(r.is_holiday, r.slot, r.peak_type) for r in b]
    assert peak_table(spark).count() <= 2 * 144


def test_hourly_slots(spark):
    """Half-covered hours: 7 and 17 open with a peak, 8 and 18 end with one;
    the other half is a special peak, which wins the tie."""
    g = spark.createDataFrame([(0, 6), (0, 7), (0, 8), (0, 17), (0, 18), (0, 19), (1, 9), (1, 5)],
                              "is_holiday int, slot int")
    got = {(r.is_holiday, r.slot): r.peak_type for r in add_peak_type(g, slot_minutes=60).collect()}
    assert got == {(0, 6): 1, (0, 7): 3, (0, 8): 3, (0, 17): 3, (0, 18): 3, (0, 19): 1,
                   (1, 9): 3, (1, 5): 0}


def test_most_minutes_decide():
    from tapcast.operators.peak import slot_ranges
    periods = {0: [("0:00", "0:40", 2), ("0:40", "1:00", 3), ("2:00", "2:20", 3), ("4:00", "4:30", 0)]}
    # 40 minutes of class 2; 40 uncovered ones; a tie of 0 with the default 1.
    assert slot_ranges(periods, 60) == [(0, 0, 1, 2)]
