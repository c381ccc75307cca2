"""A slot table kept by file equals the rebuild from all files."""
import datetime as dt
import os

import pytest

from tapcast.operators.base import slot_table
from tapcast.sources import ledger
from tapcast.sources.taps import read_taps_csv

HEAD = "time,lineID,stationID,deviceID,status,userID,payType\n"


def put(folder, name, *rows):
    """Rows (day, time, station, device, status) of January 2019."""
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(HEAD + "".join(f"2019-01-{d:02d} {t},B,{s},{v},{x},u,1\n" for d, t, s, v, x in rows))


def got(spark, path):
    t = ledger.slots(spark, path)
    return sorted(map(tuple, t.select("station_id", "service_date", "slot", "in_nums", "out_nums",
                                      "nuni_device_station").collect()))


def rebuilt(spark, folder, skip=()):
    paths = [os.path.join(folder, n) for n in sorted(os.listdir(folder)) if n not in skip]
    t = slot_table(read_taps_csv(spark, paths))
    return sorted(map(tuple, t.select("station_id", "service_date", "slot", "in_nums", "out_nums",
                                      "nuni_device_station").collect()))


A = [(1, "07:31:05", 1, 1, 1), (1, "07:32:00", 1, 2, 0), (1, "23:59:59", 2, 1, 1)]
B = [(2, "08:00:00", 1, 1, 1), (3, "00:00:01", 1, 1, 0)]  # a file that runs into the next day


@pytest.fixture()
def folders(scratch):
    return os.path.join(scratch, "files"), os.path.join(scratch, "table")


def test_late_repeated_corrected_and_vanished_files(spark, folders):
    files, path = folders
    put(files, "b.csv", *B)
    day = lambda d: dt.date(2019, 1, d)
    assert ledger.update(spark, files, path) == [day(2), day(3)]
    assert got(spark, path) == rebuilt(spark, files)
    put(files, "a.csv", *A)  # late: an earlier day
    assert ledger.update(spark, files, path) == [day(1)]
    assert got(spark, path) == rebuilt(spark, files)
    put(files, "c.csv", (3, "09:00:00", 2, 3, 1))  # a date that another file holds, too
    assert ledger.update(spark, files, path) == [day(3)]
    assert got(spark, path) == rebuilt(spark, files)
    put(files, "d.csv", *reversed(A))  # the same lines again
    assert ledger.update(spark, files, path) == []
    assert got(spark, path) == rebuilt(spark, files, skip=["d.csv"])
    put(files, "b.csv", (2, "08:00:00", 1, 1, 1), (4, "10:10:10", 1, 5, 1))  # corrected: day 3 goes, day 4 comes
    assert ledger.update(spark, files, path) == [day(2), day(3), day(4)]
    assert got(spark, path) == rebuilt(spark, files, skip=["d.csv"])
    put(files, "c.csv", (5, "09:00:00", 2, 3, 1))  # no file holds day 3 any more
    ledger.update(spark, files, path)
    assert got(spark, path) == rebuilt(spark, files, skip=["d.csv"])
    os.remove(os.path.join(files, "a.csv"))  # its repetition counts now
    assert ledger.update(spark, files, path) == [day(1)]
    assert got(spark, path) == rebuilt(spark, files)
    assert ledger.update(spark, files, path) == []


def test_a_crash_before_the_commit_is_made_good(spark, folders, monkeypatch):
    files, path = folders
    put(files, "a.csv", *A)
    ledger.update(spark, files, path)
    put(files, "b.csv", *B)
    whole = type(spark).createDataFrame

    def crash(self, data, *rest, **more):
        if data == [(2,)]:
            raise RuntimeError("lost")
        return whole(self, data, *rest, **more)

    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", crash)
        with pytest.raises(RuntimeError):
            ledger.update(spark, files, path)
    assert ledger.version(spark, path) == 1
    assert len(ledger.update(spark, files, path)) == 2
    assert got(spark, path) == rebuilt(spark, files)


def test_unreadable_text_stops_the_update(spark, folders):
    files, path = folders
    put(files, "a.csv", (1, "no time", 1, 1, 1))
    with pytest.raises(Exception, match="unreadable time"):
        ledger.update(spark, files, path)
    assert ledger.version(spark, path) == 0
