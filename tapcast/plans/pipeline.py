"""Entry 1: raw taps -> submission, as one Spark application.

    python -m tapcast.plans.pipeline --taps DIR --roadmap FILE --target 2019-01-29 \\
        --out DIR [--template FILE] [--origins 2019-01-15,2019-01-22]

Reads every daily tap file in one scan, builds the slot features, the
next-day train and score frames, encodes the slot against both targets,
fits the boosted presets per rolling origin, blends them and writes the
submission (one row per template slot).
"""

from __future__ import annotations

import argparse
import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapcast.functions.calendar import DEFAULT_CALENDAR, Calendar
from tapcast.functions.slots import SLOT_MINUTES
from tapcast.models.boosting import L1_DEPTH5, L1_DEPTH6, blend, prepare, with_rounds
from tapcast.operators.base import tap_cells
from tapcast.operators.encoding import encode_frame
from tapcast.operators.frame import (exclude_dates, observed_dates, score_frame, stage_features,
                                     train_frame)
from tapcast.operators.network import degree_from_edges
from tapcast.operators.validation import same_weekday_origins
from tapcast.plans.features import FeatureConfig, frame_columns, slot_features
from tapcast.session import build_session, materialize
from tapcast.sources.grid import read_template_csv, slot_grid
from tapcast.sources.roadmap import read_roadmap_csv
from tapcast.sources.sink import submission, write_submission
from tapcast.sources.taps import read_taps_csv, read_taps_parquet


@dataclass
class PipelineConfig:
    target_date: dt.date
    origins: list | None = None
    excluded_dates: list = field(default_factory=list)
    slot_minutes: int = SLOT_MINUTES
    special_ids: tuple = (15,)
    n_min: float = 300.0
    calendar: Calendar = DEFAULT_CALENDAR
    specs: tuple = (L1_DEPTH5, L1_DEPTH6)
    weights: tuple | None = None
    max_rounds: int | None = None
    recompute_peak: bool = False
    workers: int = 4
    # Fit the weekly profile and the encoder on rows before this date only
    # (e.g. the first origin), so no validation day feeds its own features.
    fit_before: dt.date | None = None


def forecast_frame(taps: DataFrame, degrees: DataFrame, grid: DataFrame,
                   cfg: PipelineConfig) -> DataFrame:
    """Predictions (``in_pred``, ``out_pred``) for every score row."""
    fcfg = FeatureConfig(calendar=cfg.calendar, slot_minutes=cfg.slot_minutes,
                         special_ids=cfg.special_ids, week_flow_before=cfg.fit_before)
    # One scan of the taps: slots, lines and observed dates come from their cells.
    taps = materialize(tap_cells(taps, cfg.slot_minutes))
    feats = slot_features(taps, degrees, fcfg)
    cols = frame_columns(feats)
    feats = stage_features(feats)
    tr = train_frame(feats, cfg.target_date, cfg.calendar,
                     observed=observed_dates(taps)).select(*cols)
    sc = score_frame(feats, grid, cfg.target_date, cfg.calendar, cfg.slot_minutes,
                     recompute_peak=cfg.recompute_peak).select(*cols)
    all_rows = materialize(tr.unionByName(sc))
    is_target = F.col("service_date") == F.lit(cfg.target_date)
    fit_rows = all_rows.where(~is_target)
    if cfg.fit_before is not None:
        fit_rows = fit_rows.where(F.col("service_date") < F.lit(cfg.fit_before))
    all_rows = encode_frame(all_rows, fit_rows, "slot", n_min=cfg.n_min)
    rows = exclude_dates(all_rows.where(~is_target), cfg.excluded_dates)
    score = all_rows.where(is_target)
    rows, score, _ = prepare(all_rows, rows, score)
    origins = cfg.origins or same_weekday_origins(cfg.target_date)
    specs = [with_rounds(s, cfg.max_rounds) if cfg.max_rounds else s for s in cfg.specs]
    return blend(rows, score, origins, specs, cfg.weights, workers=cfg.workers)


def run(spark: SparkSession, taps_dir: str, roadmap: str, cfg: PipelineConfig,
        template: str | None = None, taps_format: str = "csv") -> DataFrame:
    """``taps_format``: ``csv`` (daily files) or ``parquet`` (written by
    ``write_taps_parquet``, partitioned by service date)."""
    taps = (read_taps_parquet(spark, taps_dir) if taps_format == "parquet"
            else read_taps_csv(spark, taps_dir))
    degrees = degree_from_edges(read_roadmap_csv(spark, roadmap))
    if template:
        grid = read_template_csv(spark, template, cfg.slot_minutes)
    else:
        grid = slot_grid(taps.select("station_id").distinct(), cfg.target_date, cfg.slot_minutes)
    preds = forecast_frame(taps, degrees, grid, cfg)
    return submission(grid, preds, slot_minutes=cfg.slot_minutes)


def _dates(text: str | None) -> list:
    return [dt.date.fromisoformat(x) for x in text.split(",")] if text else []


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--taps", required=True)
    ap.add_argument("--roadmap", required=True)
    ap.add_argument("--target", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--template")
    ap.add_argument("--origins")
    ap.add_argument("--exclude")
    ap.add_argument("--slot-minutes", type=int, default=SLOT_MINUTES)
    ap.add_argument("--rounds", type=int)
    ap.add_argument("--fit-before", help="fit weekly profile and encoder on earlier days only")
    ap.add_argument("--taps-format", choices=["csv", "parquet"], default="csv")
    ap.add_argument("--master")
    a = ap.parse_args(argv)
    spark = build_session("tapcast-pipeline", master=a.master)
    cfg = PipelineConfig(target_date=dt.date.fromisoformat(a.target),
                         origins=_dates(a.origins) or None, excluded_dates=_dates(a.exclude),
                         slot_minutes=a.slot_minutes, max_rounds=a.rounds,
                         fit_before=dt.date.fromisoformat(a.fit_before) if a.fit_before else None)
    write_submission(run(spark, a.taps, a.roadmap, cfg, a.template, a.taps_format), a.out)


if __name__ == "__main__":
    main()
