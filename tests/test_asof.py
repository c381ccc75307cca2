"""Statistics and encodings as of each day."""
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapcast.operators.encoding import encode_asof
from tapcast.operators.seasonal import add_week_flow_asof

DDL = ("station_id int, service_date date, slot int, weekday int, hour int, minute int, in_now long, out_now long")


def day(k):
    return dt.date(2024, 1, 1) + dt.timedelta(days=k)


def slots(days):
    rng = random.Random(7)
    rows = []
    for k in range(days):
        for s in (1, 2):
            for slot in rng.sample(range(40, 52), 8):
                rows.append((s, day(k), slot, day(k).isoweekday(), slot // 6, slot % 6 * 10, rng.randint(0, 9), rng.randint(0, 9)))
    return rows


def profile(spark, rows):
    return {(r.station_id, r.service_date, r.slot): r
            for r in add_week_flow_asof(spark.createDataFrame(rows, DDL)).collect()}


def test_profile_against_brute_force_and_later_days_change_nothing(spark):
    rows = slots(30)
    got = profile(spark, rows)
    for s, d, slot, weekday, hour, minute, _, _ in rows:
        before = [r for r in rows if r[0] == s and r[1] < d and r[3] == weekday and r[4] == hour]
        fine = [r for r in before if r[5] == minute]
        r = got[s, d, slot]
        assert (r.whm_days, r.wh_rows) == (len(fine), len(before))
        assert r.in_whm_max == max((x[6] for x in fine), default=0)
        assert r.out_whm_min == min((x[7] for x in fine), default=0)
        assert r.in_whm_mean == pytest.approx(np.mean([x[6] for x in fine]) if fine else 0)
        assert r.out_wh_mean == pytest.approx(np.mean([x[7] for x in before]) if before else 0)
        assert r.in_wh_max == max((x[6] for x in before), default=0)
    early = profile(spark, [r for r in rows if r[1] < day(17)])
    assert all(got[k] == r for k, r in early.items()) and early


def encoded(spark, rows, **options):
    df = spark.createDataFrame(rows, "k int, service_date date, slot int, in_nums long, out_nums long, known boolean")
    return {r.k: r for r in encode_asof(df, F.col("known"), **options).collect()}


ROWS = [(0, day(0), 1, 4, 1, True), (1, day(0), 2, 2, 0, True), (2, day(1), 1, 6, 3, True), (3, day(2), 1, 0, 0, False),
        (4, day(2), 3, 5, 5, True), (5, day(3), 1, 9, 9, True), (6, day(3), None, 1, 1, True), (7, day(3), 3, None, 2, True)]


def test_encoding_uses_earlier_known_rows_only(spark):
    got = encoded(spark, ROWS, n_min=1.0)
    assert got[0].in_slot_enc == 0.0  # no earlier date
    assert got[2].in_slot_enc == 4.0  # one earlier row of slot 1
    assert got[3].in_slot_enc == 5.0 and got[3].out_slot_enc == 2.0  # two; its own day isn't known
    assert got[5].in_slot_enc == 5.0  # a row without a known target tells nothing
    assert got[4].in_slot_enc == pytest.approx(4.0)  # unseen slot: the prior, (4 + 2 + 6) / 3
    prior = (4 + 2 + 6 + 5) / 4
    assert got[6].in_slot_enc == pytest.approx(prior)  # a null group is unseen
    assert got[7].in_slot_enc == 5.0  # the day before's only row of slot 3


def test_appending_later_days_changes_no_earlier_row(spark):
    later = ROWS + [(8, day(4), 1, 100, 100, True), (9, day(5), 3, 100, 100, True)]
    old, new = encoded(spark, ROWS, n_min=3.0), encoded(spark, later, n_min=3.0)
    assert all(new[k] == r for k, r in old.items())


@pytest.mark.parametrize("stat", ["mode", "var", "skewness", "kurtosis", "median", "prior"])
def test_statistics_without_history_are_numbers(spark, stat):
    got = encoded(spark, ROWS, n_min=1.0, stat_type=stat)
    assert all(r.in_slot_enc == r.in_slot_enc for r in got.values())
    if stat == "prior":
        assert got[4].in_slot_enc == pytest.approx(4.0)
