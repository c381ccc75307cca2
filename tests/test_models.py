"""Model layer on the sf0.001 hourly frame with few rounds (slow-ish)."""
import pytest
from pyspark.sql import functions as F

from tapcast.models.boosting import L1_DEPTH5, L1_DEPTH6, blend, forecast, prepare, with_rounds
from tapcast.models.stacking import StackedBoosters
from tapcast.plans import fixture as fx

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def prepared(spark):
    tr, sc = fx.frames(spark, SF, 60, staged=True)
    all_rows = fx.encoded_frame(spark, SF, "mean", 60, frames_=(tr, sc))
    rows = fx.model_rows(all_rows)
    score = all_rows.where(F.col("service_date") == fx.TARGET_DATE)
    return prepare(all_rows, rows, score)


def test_forecast_deterministic_and_keyed(spark, prepared):
    rows, score, feats = prepared
    assert "slot" not in feats and "in_nums" not in feats and "in_slot_enc" in feats
    spec = with_rounds(L1_DEPTH6, 4)
    a = forecast(rows, score, fx.ORIGINS, spec).select("station_id", "slot", "in_pred", "out_pred")
    b = forecast(rows, score, fx.ORIGINS, spec).select("station_id", "slot", "in_pred", "out_pred")
    ra, rb = sorted(map(tuple, a.collect())), sorted(map(tuple, b.collect()))
    assert ra == rb and len(ra) == score.count()


def test_blend_is_mean_of_parts(spark, prepared):
    rows, score, _ = prepared
    s1, s2 = with_rounds(L1_DEPTH5, 3), with_rounds(L1_DEPTH6, 3)
    out = blend(rows, score, fx.ORIGINS, (s1, s2), targets=(("in_nums", "in_pred"),))
    bad = out.where(F.abs(F.col("in_pred") - (F.col(f"in_pred_{s1.name}") + F.col(f"in_pred_{s2.name}")) / 2) > 1e-9)
    assert bad.count() == 0


def test_stacking_rows(spark, prepared):
    rows, score, _ = prepared
    bases = (with_rounds(L1_DEPTH6, 3), with_rounds(L1_DEPTH5, 3))
    model = StackedBoosters("in_nums", fx.ORIGINS, bases=bases, output_col="in_pred").fit(rows)
    out = model.transform(score)
    assert out.count() == score.count()
    assert out.where(F.col("in_pred").isNull()).count() == 0


def test_empty_origin_is_an_error(spark, prepared):
    import datetime as dt

    from tapcast.models.boosting import fit_best_rounds
    from tapcast.operators.validation import fold
    rows, _, _ = prepared
    tr, va = fold(rows, dt.date(2030, 1, 1))
    with pytest.raises(ValueError, match="origin day"):
        fit_best_rounds(with_rounds(L1_DEPTH6, 3), tr, va, "in_nums")


def test_prefix_of_a_longer_fit_is_the_shorter_fit(spark, prepared):
    from tapcast.models.boosting import prefix
    rows, score, _ = prepared
    for spec in (L1_DEPTH6, L1_DEPTH5):
        long, short = spec.estimator("in_nums", 5).fit(rows), spec.estimator("in_nums", 2).fit(rows)
        cut = prefix(long, 2)
        assert cut.getNumTrees == 2
        a, b = ([round(r.prediction, 9) for r in m.transform(score).orderBy("station_id", "slot").collect()]
                for m in (cut, short))
        assert a == b


def test_rounds_go_on_while_the_last_is_best(spark, prepared):
    from dataclasses import replace

    from tapcast.models.boosting import fit_best_rounds
    from tapcast.operators.validation import fold
    rows, _, _ = prepared
    tr, va = fold(rows, fx.ORIGINS[0])
    # The hour is a feature, so every round comes closer to it.
    spec = replace(L1_DEPTH5, loss="squared", max_depth=1, max_iter=1, max_rounds=6)
    rounds, _, model = fit_best_rounds(spec, tr, va, "hour")
    assert rounds == model.getNumTrees == 6


def test_boosters_beat_yesterdays_count(spark, prepared):
    from tapcast.models.boosting import fit_best_rounds
    from tapcast.operators.validation import fold
    rows, _, _ = prepared
    for o in fx.ORIGINS:
        tr, va = fold(rows, o)
        err = fit_best_rounds(with_rounds(L1_DEPTH6, 10), tr, va, "in_nums")[1]
        naive = va.agg(F.avg(F.abs(F.col("in_nums") - F.col("in_now")))).first()[0]
        assert err < naive
