import datetime as dt

from pyspark.sql import functions as F

from helpers import by_key, taps_df, ts
from tapcast.operators.frame import observed_dates, score_frame, train_frame
from tapcast.plans.features import FeatureConfig, frame_columns, slot_features
from tapcast.sources.grid import slot_grid

TARGET = dt.date(2024, 1, 5)


def _features(spark):
    rows = [(ts(1, 1, 40), "A", 1, 1, 1), (ts(1, 1, 41), "A", 1, 2, 0),   # day 1 slot 10
            (ts(2, 1, 40), "A", 1, 1, 1),                                # day 2 slot 10
            (ts(2, 1, 55), "A", 1, 1, 0),                                # day 2 slot 11
            (ts(4, 1, 40), "A", 1, 3, 1), (ts(4, 1, 40), "A", 2, 4, 0)]  # day 4 (day 3 missing)
    taps = taps_df(spark, rows)
    degrees = spark.createDataFrame([(1, 2)], "station_id int, station_type bigint")
    return taps, slot_features(taps, degrees, FeatureConfig())


def test_train_rows_and_missing_days(spark):
    taps, f = _features(spark)
    tr = train_frame(f, TARGET, observed=observed_dates(taps)).collect()
    # day1 -> day2 kept; day2 -> day3 (no taps) dropped; day4 -> day5 is the target.
    assert sorted((r.service_date.day, r.slot) for r in tr) == [(2, 10)]
    r = tr[0]
    assert (r.in_nums, r.out_nums, r.in_now, r.out_now) == (1, 0, 1, 1)
    assert (r.weekday, r.day, r.yesterday_is_holiday, r.today_is_holiday) == (2, 2, 1, 0)
    # Without the observed-date table the same rows come out.
    assert train_frame(f, TARGET).count() == 1


def test_score_frame_outer_join_and_backfill(spark):
    taps, f = _features(spark)
    stations = spark.createDataFrame([(1,), (2,), (3,)], "station_id int")
    grid = slot_grid(stations, TARGET)
    sc = score_frame(f, grid, TARGET).select(*frame_columns(f))
    rows = sc.collect()
    assert len(rows) == 3 * 144                       # score rows = grid rows
    r = by_key(rows, "station_id", "slot")
    feat = r[(1, 10)]                                 # feature row of day 4
    assert (feat.in_now, feat.peak_type, feat.station_type, feat.weekday) == (1, 0, 2, 5)
    tmpl = r[(1, 50)]                                 # template-only slot, same station
    assert (tmpl.in_now, tmpl.peak_type, tmpl.station_type, tmpl.weekday) == (0, 0, 2, 5)
    assert (tmpl.hour, tmpl.minute, tmpl.day, tmpl.in_nums) == (8, 20, 5, 0)
    absent = r[(3, 10)]                               # station with no taps at all
    assert (absent.weekday, absent.nuni_device_station, absent.line_size) == (0, 0, 0)
    assert r[(2, 10)].station_type == 0               # station absent from the degree table
    peaks = score_frame(f, grid, TARGET, recompute_peak=True).where("station_id = 1 AND slot = 50")
    assert peaks.first().peak_type == 3               # 8:20 on a workday: special peak


def test_feature_only_slot_outside_grid(spark):
    taps, f = _features(spark)
    grid = slot_grid(spark.createDataFrame([(2,)], "station_id int"), TARGET)
    sc = score_frame(f, grid, TARGET)
    assert sc.count() == 144 + 1                      # station 1's feature row is kept
    assert sc.where("station_id = 1").first().in_now == 1


def test_fixture_frames_unique_keys(spark):
    from tapcast.plans import fixture as fx
    tr, sc = fx.frames(spark, "/root/testdata/sf0.001")
    allr = tr.unionByName(sc)
    assert allr.groupBy("station_id", "service_date", "slot").count().where("count > 1").count() == 0
    assert sc.count() == fx.grid(spark, "/root/testdata/sf0.001").count()
    assert tr.agg(F.max("service_date")).first()[0] < fx.TARGET_DATE


def test_hourly_slots_through_the_stack(spark):
    from tapcast.plans import fixture as fx
    tr, sc = fx.frames(spark, "/root/testdata/sf0.001", 60, staged=True)
    a = tr.agg(F.min("slot"), F.max("slot"), F.max("minute"),
               F.sum((F.col("in_whm_mean") != F.col("in_wh_mean")).cast("int"))).first()
    assert a[0] >= 0 and a[1] <= 23 and a[2] == 0 and a[3] == 0
    assert sc.count() == 25 * 24
    assert tr.unionByName(sc).groupBy("station_id", "service_date", "slot").count() \
        .where("count > 1").count() == 0


def test_week_flow_before_excludes_later_days(spark):
    from tapcast.operators.seasonal import add_week_flow
    rows = [(1, dt.date(2024, 1, d), 3, 8, 0, v, 0) for d, v in ((1, 2), (8, 4), (15, 100))]
    df = spark.createDataFrame(rows, "station_id int, service_date date, weekday int, hour int, "
                                     "minute int, in_now bigint, out_now bigint")
    got = {r.service_date.day: r.in_whm_mean
           for r in add_week_flow(df, before=dt.date(2024, 1, 15)).collect()}
    assert got == {1: 3.0, 8: 3.0, 15: 3.0}
