"""Blend weights, the feature screen, the history grid and device sketches."""
import datetime as dt

import numpy as np
import pytest

from tapcast.models.blending import blend_weights, lattice
from tapcast.operators.frame import feature_screen
from tapcast.operators.sketches import device_sketches, standard_error, united, with_estimate
from tapcast.sources.grid import slot_grid_history

D = dt.date(2024, 1, 1)


def test_weights_of_three_predictors_against_a_search(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(0, 10, (400, 3))
    y = p @ [0.237, 0.5, 0.263] + rng.normal(0, 0.05, 400)
    oof = spark.createDataFrame([(float(t), *map(float, x)) for t, x in zip(y, p)] + [(1.0, None, 2.0, 3.0)],
                                "y double, a double, b double, c double")
    w, mae = blend_weights(oof, "y", ["a", "b", "c"], steps=(100, 20, 4))
    fine = [(np.abs(y - p @ [i / 1000, j / 1000, 1 - (i + j) / 1000]).mean(), i, j)
            for i in range(0, 1001, 20) for j in range(0, 1001 - i, 20)]
    assert sum(w) == 1000 and min(w) >= 0 and mae <= min(fine)[0] + 1e-9
    assert np.abs(np.array(w) / 1000 - [0.237, 0.5, 0.263]).max() < 0.01


def test_weights_at_the_edges(spark):
    oof = spark.createDataFrame([(1.0, 1.0, 9.0), (2.0, 2.0, 9.0)], "y double, a double, b double")
    assert blend_weights(oof, "y", ["a", "b"]) == ((1000, 0), 0.0)
    w, mae = blend_weights(oof.limit(0), "y", ["a", "b"])
    assert w == (500, 500) and mae != mae
    assert len(lattice(3, 100)) == 66


def test_screen_ranks_by_correlation(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a + b), float(a - b), float(a), float(b), 1.0)
            for a, b in rng.integers(0, 20, (300, 2))]
    df = spark.createDataFrame(rows, "in_nums double, out_nums double, a double, b double, k double")
    got = feature_screen(df, ["a", "b", "k"], top=3).collect()
    by = {(r.target, r["rank"]): (r.feature, r["corr"]) for r in got}
    assert by["in_nums", 1] == ("a+b", 1.0) and by["out_nums", 1] == ("a-b", 1.0) and len(got) == 6
    x = np.array(rows)
    ratio = x[:, 3] > 0
    want = np.corrcoef(x[ratio, 2] / x[ratio, 3], x[ratio, 0])[0, 1]
    full = {(r.target, r.feature): r["corr"] for r in feature_screen(df, ["a", "b", "k"], top=99).collect()}
    assert full["in_nums", "a/b"] == pytest.approx(want, abs=1e-6)
    assert feature_screen(df.limit(0), ["a", "b"]).count() == 0


def test_history_grid_fills_gaps_over_days(spark):
    day = lambda k: D + dt.timedelta(days=k)
    rows = [(1, day(0), 5, 2, 1), (1, day(0), 6, 1, 0), (1, day(3), 0, 4, 4), (2, day(1), 143, 1, 1)]
    slots = spark.createDataFrame(rows, "station_id int, service_date date, slot int, in_nums long, out_nums long")
    got = {(r.station_id, r.service_date, r.slot): r for r in slot_grid_history(slots).collect()}
    assert len(got) == 4 * 144 + 144
    seen = {(s, d, k): (i, o) for s, d, k, i, o in rows}
    for key, r in got.items():
        assert (r.in_nums, r.out_nums) == seen.get(key, (0, 0)) and r.observed == (key in seen)
    assert slot_grid_history(slots.limit(0)).count() == 0


def test_united_sketches_count_devices_once(spark):
    cells = spark.range(60_000).selectExpr(
        "cast(id % 2 as int) station_id", "date'2024-01-01' service_date", "cast(id % 12 as int) slot",
        "case when id % 100 = 0 then null else cast(id % 5000 as int) end device_id")
    stored = device_sketches(cells)
    got = with_estimate(united(stored, "station_id", "service_date")).collect()
    true = {s: len({i % 5000 for i in range(60_000) if i % 2 == s and i % 100}) for s in (0, 1)}
    assert len(got) == 2 and all(abs(r.estimate - true[r.station_id]) <= 3 * standard_error() * true[r.station_id] for r in got)
