import datetime as dt
import os

import pytest

from tapcast.operators.base import slot_table
from tapcast.sources.grid import read_template_csv, slot_grid
from tapcast.sources.sink import submission, write_submission
from tapcast.sources.taps import (read_taps_csv, read_taps_parquet, rejected_taps_csv,
                                  write_taps_parquet)

CSV = """time,lineID,stationID,deviceID,status,userID,payType
2019-01-01 07:31:05,B,15,3001,1,Uabc,1
2019-01-01 07:39:59,B,15,3002,0,Uabd,2
2019-01-01 07:40:00,A,2,101,1,Uabe,0
,A,2,101,1,Uabe,0
2019-01-01 07:41:00,A,,101,1,Uabe,0
"""


def test_tap_csv_and_parquet_roundtrip(spark, scratch):
    d = os.path.join(scratch, "taps")
    os.makedirs(d)
    with open(os.path.join(d, "record_2019-01-01.csv"), "w") as f:
        f.write(CSV)
    with open(os.path.join(d, "notes.txt"), "w") as f:
        f.write("not a tap file\n")
    taps = read_taps_csv(spark, d)
    assert taps.count() == 3                          # null time / station dropped, txt skipped
    assert dict(taps.dtypes)["time"] == "timestamp_ntz"
    out = os.path.join(scratch, "taps_pq")
    write_taps_parquet(taps, out)
    assert sorted(os.listdir(out))[0].startswith("service_date=2019-01-01") or \
        any(x.startswith("service_date=") for x in os.listdir(out))
    back = read_taps_parquet(spark, out)
    assert sorted(map(tuple, back.select(*taps.columns).collect())) == \
        sorted(map(tuple, taps.collect()))


def test_bad_tap_rows_are_never_lost_silently(spark, scratch):
    d = os.path.join(scratch, "bad")
    os.makedirs(d)
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("time,lineID,stationID,deviceID,status,userID,payType\n"
                "2019-01-01 07:31:05,B,15,D17,1,u,x\n2019-01-01 07:32:05,B,15,D18,0,u,x\n"
                "2019-01-01 07:33:05,B,S4,D18,0,u,x\nnot a time,B,15,D18,0,u,x\n"
                "2019-01-01 07:34:05,B,15,D18,in,u,x\n")
    with pytest.raises(Exception, match="unreadable"):
        read_taps_csv(spark, d).collect()
    kept = read_taps_csv(spark, d, bad="reject")
    assert sorted(r.device_id for r in kept.collect()) == ["D17", "D18"]
    assert sorted(r.reason for r in rejected_taps_csv(spark, d).collect()) == ["stationID", "status", "time"]
    assert slot_table(kept).first().nuni_device_station == 2


def test_template_and_submission(spark, scratch):
    p = os.path.join(scratch, "tmpl.csv")
    with open(p, "w") as f:
        f.write("stationID,startTime,endTime,inNums,outNums\n")
        f.write("0,2019-01-29 00:00:00,2019-01-29 00:10:00,,\n")
        f.write("0,2019-01-29 07:30:00,2019-01-29 07:40:00,,\n")
    t = read_template_csv(spark, p).collect()
    assert [(r.station_id, r.service_date, r.slot) for r in t] == \
        [(0, dt.date(2019, 1, 29), 0), (0, dt.date(2019, 1, 29), 45)]
    grid = slot_grid(spark.createDataFrame([(0,), (1,)], "station_id int"), "2019-01-29")
    preds = spark.createDataFrame([(1, dt.date(2019, 1, 29), 45, 3.5, 1.25)],
                                  "station_id int, service_date date, slot int, in_pred double, out_pred double")
    sub = submission(grid, preds)
    assert sub.count() == 288
    r = sub.where("stationID = 1 AND startTime = '2019-01-29 07:30:00'").first()
    assert (r.endTime, r.inNums, r.outNums) == ("2019-01-29 07:40:00", 3.5, 1.25)
    assert sub.where("stationID = 0 AND inNums IS NULL").count() == 144
    last = sub.where("stationID = 0 AND startTime = '2019-01-29 23:50:00'").first()
    assert last.endTime == "2019-01-30 00:00:00"
    out = os.path.join(scratch, "sub")
    with pytest.raises(Exception, match="no inNums for station"):
        write_submission(sub, os.path.join(scratch, "holes"))
    write_submission(sub.na.fill(0.0, ["inNums", "outNums"]), out)
    rows = []
    for name in sorted(x for x in os.listdir(out) if x.endswith(".csv")):
        with open(os.path.join(out, name)) as f:
            rows += [tuple(line.split(",")[:2]) for line in f.read().splitlines()[1:]]
    assert len(rows) == 288 and rows == sorted(rows)


def test_partitioned_taps_prune_dates(spark, scratch):
    from tapcast.operators.frame import observed_dates
    from tapcast.operators.network import station_lines
    from tapcast.plans import fixture as fx
    taps = fx.taps(spark, "/root/testdata/sf0.001")
    out = os.path.join(scratch, "taps_by_day")
    write_taps_parquet(taps, out)
    back = read_taps_parquet(spark, out)
    assert "service_date" in back.columns
    assert observed_dates(back).count() == observed_dates(taps).count()
    a = sorted(map(tuple, station_lines(back).collect()))
    b = sorted(map(tuple, station_lines(taps).collect()))
    assert a == b
    plan = back.where(back.service_date == dt.date(2024, 1, 5))._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PartitionFilters: [isnotnull(service_date" in plan


def test_template_calendar_columns(spark, scratch):
    """V2: the template grid gets the calendar columns of its day."""
    from tapcast.operators.base import with_calendar
    p = os.path.join(scratch, "tmpl2.csv")
    with open(p, "w") as f:
        f.write("stationID,startTime,endTime,inNums,outNums\n")
        f.write("3,2019-02-04 17:30:00,2019-02-04 17:40:00,,\n")
    r = with_calendar(read_template_csv(spark, p)).first()
    assert (r.slot, r.weekday, r.is_holiday, r.day, r.hour, r.minute) == (105, 1, 1, 4, 17, 30)
