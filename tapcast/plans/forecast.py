"""Model queries (M1-M10) at 10-minute slots: rows only, no SQL oracle (the
same mechanics with SQL-expressible predictors: ``oof_matrix``,
``blend_submission``).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from tapcast.models.boosting import L1_DEPTH5, L1_DEPTH6, L2_DEPTH9, blend, forecast, prepare
from tapcast.models.stacking import StackedBoosters
from tapcast.plans import fixture as fx
from tapcast.sources.sink import submission

FORECAST_SLOT_MINUTES = 10
KEYS = ["station_id", "service_date", "slot"]


def _prepared(spark: SparkSession, sf: str):
    tr, sc = fx.frames(spark, sf, FORECAST_SLOT_MINUTES, staged=True)
    all_rows = fx.encoded_frame(spark, sf, "mean", FORECAST_SLOT_MINUTES, frames_=(tr, sc))
    rows = fx.model_rows(all_rows)
    score = all_rows.where(all_rows.service_date == fx.TARGET_DATE)
    return prepare(all_rows, rows, score)


def q_gbt_forecast(spark: SparkSession, sf: str) -> DataFrame:
    rows, score, _ = _prepared(spark, sf)
    return forecast(rows, score, fx.ORIGINS, L1_DEPTH6).select(*KEYS, "in_pred", "out_pred")


def q_l2_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """The squared-loss preset on its own (M5): best rounds, refit, fold mean."""
    rows, score, _ = _prepared(spark, sf)
    return forecast(rows, score, fx.ORIGINS, L2_DEPTH9).select(*KEYS, "in_pred", "out_pred")


def q_blend_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """The final output: mean of two presets, as a submission."""
    rows, score, _ = _prepared(spark, sf)
    preds = blend(rows, score, fx.ORIGINS, (L1_DEPTH5, L1_DEPTH6), workers=8)
    grid = fx.grid(spark, sf, FORECAST_SLOT_MINUTES)
    return submission(grid, preds, slot_minutes=FORECAST_SLOT_MINUTES)


def q_stacked_forecast(spark: SparkSession, sf: str) -> DataFrame:
    rows, score, _ = _prepared(spark, sf)
    targets = (("in_nums", "in_pred"), ("out_nums", "out_pred"))
    # The two targets' stacks are independent: fit them concurrently.
    with ThreadPoolExecutor(max_workers=len(targets)) as ex:
        models = list(ex.map(lambda t: StackedBoosters(t[0], fx.ORIGINS, output_col=t[1],
                                                       workers=8).fit(rows), targets))
    out = score
    for model in models:
        out = model.transform(out).drop(*model.pred_cols)
    return out.select(*KEYS, "in_pred", "out_pred")


def forecast_queries() -> dict:
    return {"gbt_forecast": q_gbt_forecast, "l2_forecast": q_l2_forecast, "blend_forecast": q_blend_forecast,
            "stacked_forecast": q_stacked_forecast}
