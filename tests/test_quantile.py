import math

import numpy as np
import pytest

from tapcast.operators import quantile
from tapcast.operators.quantile import exact_median, value_at

SAMPLES = {
    "odd": [3.0, 1.0, 2.0], "even": [4.0, 1.0, 3.0, 2.0], "ties": [1.0] * 5 + [2.0] * 5, "one": [7.5],
    "infinite": [-math.inf, 1.0, 2.0, math.inf, math.inf], "wide": [-1e308, -1.0, 0.0, 1e-300, 2e-300, 1e308],
    "close": [1.0, np.nextafter(1.0, 2), np.nextafter(np.nextafter(1.0, 2), 2), 1e9], "zero": [-0.0, 0.0, 1.0],
}


@pytest.mark.parametrize("name", sorted(SAMPLES))
@pytest.mark.parametrize("bins", [2, 1024])
def test_against_numpy(spark, monkeypatch, name, bins):
    monkeypatch.setattr(quantile, "BINS", bins)
    x = SAMPLES[name]
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    assert exact_median(df, "v") == np.median(x)
    assert [value_at(df, "v", k)[0] for k in (0, len(x) - 1)] == [min(x), max(x)]


def test_weights_and_no_rows(spark):
    df = spark.createDataFrame([(1.0, 3), (5.0, 1), (9.0, 2)], "v double, w int")
    assert exact_median(df, "v", "w") == 3.0  # 1 1 1 5 9 9
    assert exact_median(df.limit(0), "v", "w") is None
    with pytest.raises(ValueError):
        value_at(df, "v", 6, "w")


def test_a_pass_sends_few_rows(spark):
    """Many distinct values: no pass's result is larger than the bins."""
    df = spark.range(200_000).selectExpr("cast(xxhash64(id) as double) as v")
    got = exact_median(df, "v")
    assert got == df.selectExpr("percentile(v, 0.5)").first()[0]
