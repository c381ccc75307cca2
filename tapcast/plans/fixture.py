"""Binding of the driver tables to the tap pipeline.

taps: ``events`` (station = user_id mod 25 = n_nationkey, line = region
name, device = props.k, status 1 for click/purchase); road map: nations of
one region are adjacent; target 2024-01-31 with origins one and two weeks
earlier; 2024-01-02 (features of New Year's day) is left out of training.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapcast.operators.base import tap_cells
from tapcast.operators.encoding import encode_frame
from tapcast.operators.frame import (exclude_dates, observed_dates, score_frame, stage_features,
                                     train_frame)
from tapcast.operators.network import degree_from_groups
from tapcast.plans.features import FeatureConfig, frame_columns, slot_features
from tapcast.sources.grid import slot_grid
from tapcast.session import materialize
from tapcast.sources.roadmap import roadmap_edges_from_wide
from tapcast.sources.taps import taps_from_events

# Fixed values of the fixture binding.
N_STATIONS = 25
TARGET_DATE = dt.date(2024, 1, 31)
ORIGINS = [dt.date(2024, 1, 17), dt.date(2024, 1, 24)]
EXCLUDED_DATES = [dt.date(2024, 1, 2)]
SPECIAL_IDS = (15,)
N_MIN = 300


_TABLES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver table as a lazy DataFrame, built once per application (the
    footer read and file listing are not repeated for every query)."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _TABLES[key]


def taps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taps_from_events(table(spark, sf_dir, "events"), table(spark, sf_dir, "nation"),
                            table(spark, sf_dir, "region"), N_STATIONS)


def cells(spark: SparkSession, sf_dir: str, slot_minutes: int = 10) -> DataFrame:
    """The taps' cells, staged: the only scan of ``events`` of a query that
    takes slots, lines and dates from them."""
    return materialize(tap_cells(taps(spark, sf_dir), slot_minutes))


def station_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("station_id"), F.col("n_regionkey").alias("group_id"))


def roadmap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide 0/1 road map, as a file would give it: one row and one column
    per station, 1 between nations of one region."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    # A station's cell: is there a nation with that number in its region?
    members = n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("members"))
    wide = n.join(members, "n_regionkey")
    return wide.select(F.col("n_nationkey").alias("station"), *[
        (F.array_contains("members", s) & (F.col("n_nationkey") != s)).cast("int").alias(str(s))
        for s in range(N_STATIONS)])


def roadmap_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roadmap_edges_from_wide(roadmap_matrix(spark, sf_dir), "station")


def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degree_from_groups(station_groups(spark, sf_dir))


def grid(spark: SparkSession, sf_dir: str, slot_minutes: int = 10) -> DataFrame:
    stations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("station_id"))
    return slot_grid(stations, TARGET_DATE, slot_minutes)


def features(spark: SparkSession, sf_dir: str, slot_minutes: int = 10, cells_=None,
             with_attributes: bool = True) -> DataFrame:
    cfg = FeatureConfig(slot_minutes=slot_minutes, special_ids=SPECIAL_IDS)
    if cells_ is None:
        cells_ = cells(spark, sf_dir, slot_minutes) if with_attributes else taps(spark, sf_dir)
    return slot_features(cells_, degrees(spark, sf_dir), cfg, with_attributes=with_attributes)


def frames(spark: SparkSession, sf_dir: str, slot_minutes: int = 10,
           staged: bool = False, want=("train", "score")):
    """(train, score) supervised frames with a fixed column order; a frame not
    in ``want`` is None (and costs nothing).

    ``staged``: write the features once (with next-day targets) when both
    frames will be consumed together, so the feature plan runs once."""
    taps_ = cells(spark, sf_dir, slot_minutes)
    f = features(spark, sf_dir, slot_minutes, taps_)
    cols = frame_columns(f)
    if staged:
        f = stage_features(f)
    tr = sc = None
    if "train" in want:
        tr = train_frame(f, TARGET_DATE, observed=observed_dates(taps_)).select(*cols)
    if "score" in want:
        sc = score_frame(f, grid(spark, sf_dir, slot_minutes), TARGET_DATE,
                         slot_minutes=slot_minutes).select(*cols)
    return tr, sc


def all_rows(spark: SparkSession, sf_dir: str, slot_minutes: int = 10) -> DataFrame:
    """Train and score rows, staged."""
    tr, sc = frames(spark, sf_dir, slot_minutes, staged=True)
    return materialize(tr.unionByName(sc))


def encoded_frame(spark: SparkSession, sf_dir: str, stat_type: str = "mean",
                  slot_minutes: int = 10, frames_=None, group_col: str = "slot",
                  n_min: float = N_MIN, **options) -> DataFrame:
    """All rows (train + score) with ``in_slot_enc``/``out_slot_enc`` fitted
    on the train rows (E10)."""
    tr, sc = frames_ if frames_ is not None else frames(spark, sf_dir, slot_minutes, staged=True)
    # Both encoders fit on the train rows and scan all rows for their
    # medians: write the frame once to the checkpoint folder and read it
    # back, instead of re-running the feature plan for every pass.
    union = tr.unionByName(sc)
    if group_col not in union.columns and group_col == "station_slot":
        union = union.withColumn("station_slot", F.col("station_id") * 1000 + F.col("slot"))
    all_rows = materialize(union)
    tr = all_rows.where(F.col("service_date") != F.lit(TARGET_DATE))
    return encode_frame(all_rows, tr, group_col, stat_type=stat_type, n_min=n_min, **options)


def model_rows(all_rows: DataFrame) -> DataFrame:
    """Rows the models train on: not the target date, not excluded dates."""
    return exclude_dates(all_rows.where(F.col("service_date") != F.lit(TARGET_DATE)),
                         EXCLUDED_DATES)
