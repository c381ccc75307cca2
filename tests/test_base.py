from pyspark.sql import functions as F

from helpers import by_key, taps_df, ts
from tapcast.operators.base import slot_table


def test_counts_devices_and_nulls(spark):
    rows = [
        (ts(1, 7, 1), "A", 1, 10, 1), (ts(1, 7, 2), "A", 1, 10, 0), (ts(1, 7, 9), "A", 1, 11, 1),
        (ts(1, 7, 12), "A", 1, 12, 1),                       # slot 43, new device
        (ts(1, 8, 5), "A", 1, 10, 0),                        # hour 8, device seen at 7
        (ts(1, 9, 0), "A", 1, None, None),                   # all-null status group
        (ts(1, 9, 0), None, None, 10, 1),                    # null station: dropped
        (ts(2, 7, 1), "A", 1, 13, 1),                        # another day
    ]
    out = slot_table(taps_df(spark, rows).where(F.col("station_id").isNotNull())).collect()
    r = by_key(out, "service_date", "slot")
    import datetime as dt
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    assert len(out) == 5
    a = r[(d1, 42)]
    assert (a.in_nums, a.out_nums) == (2, 1)
    assert (a.hour, a.minute, a.weekday, a.is_holiday, a.day) == (7, 0, 1, 1, 1)  # New Year
    assert a.nuni_device_station_slot == 2 and a.nuni_device_station_hour == 3
    assert a.nuni_device_station == 3
    assert r[(d1, 43)].nuni_device_station_slot == 1
    assert r[(d1, 48)].nuni_device_station_hour == 1
    n = r[(d1, 54)]
    assert (n.in_nums, n.out_nums, n.nuni_device_station_slot) == (0, 0, 0)
    assert r[(d2, 42)].nuni_device_station == 1


def test_in_plus_out_equals_taps(spark):
    from tapcast.plans import fixture as fx
    taps = fx.taps(spark, "/root/testdata/sf0.001")
    st = slot_table(taps, with_devices=False)
    tot = st.agg(F.sum(F.col("in_nums") + F.col("out_nums"))).first()[0]
    assert tot == taps.count()
    assert st.groupBy("station_id", "service_date", "slot").count().where("count > 1").count() == 0
