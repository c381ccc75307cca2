"""Registered queries: one per operator family of the survey, each reading
the whole driver tables at ``sf_dir``. Doubles are rounded to 6 places so
results compare order-insensitively with the DuckDB oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapcast.functions.calendar import is_holiday, iso_weekday, month_day_key
from tapcast.functions.slots import slot_hour
from tapcast.models.blending import blend_weights
from tapcast.operators.base import slot_table
from tapcast.operators.encoding import encode_asof
from tapcast.operators.frame import add_ratio_features, cohort, feature_screen
from tapcast.operators.metrics import competition_score
from tapcast.models.simple import base_predictions, fold_mean_blend
from tapcast.operators.neighbors import (add_neighbor_slots, neighbor_station_flow_by_edges,
                                         neighbor_station_flow_by_group)
from tapcast.operators.network import (add_line_size, add_roadmap_row, add_special_flag,
                                       add_station_type, degree_from_edges, line_size, station_lines)
from tapcast.operators.peak import add_peak_type
from tapcast.operators.seasonal import add_week_flow_asof
from tapcast.operators.sketches import device_sketches, standard_error, united, with_estimate
from tapcast.operators.validation import fold_sizes, out_of_fold
from tapcast.plans import fixture as fx
from tapcast.plans.features import round_doubles
from tapcast.session import ensure_checkpoint_dir, materialize
from tapcast.sources import ledger
from tapcast.sources.grid import slot_grid_history
from tapcast.sources.sink import submission
from tapcast.sources.taps import write_taps_csv

KEYS = ["station_id", "service_date", "slot"]


def q_slot_counts(spark: SparkSession, sf: str) -> DataFrame:
    return slot_table(fx.taps(spark, sf), with_devices=False)


def q_device_uniques(spark: SparkSession, sf: str) -> DataFrame:
    return slot_table(fx.taps(spark, sf)).select(
        *KEYS, "nuni_device_station", "nuni_device_station_hour", "nuni_device_station_slot")


def q_holiday_flag(spark: SparkSession, sf: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    return (fx.table(spark, sf, "orders").where(F.col("o_orderdate").isNotNull())
            .groupBy(d.alias("service_date")).agg(F.count(F.lit(1)).alias("n_orders"))
            .select("service_date", iso_weekday("service_date").alias("weekday"),
                    month_day_key("service_date").alias("month_day"),
                    is_holiday("service_date").alias("is_holiday"), "n_orders"))


def _neighbors(spark, sf):
    return add_neighbor_slots(slot_table(fx.taps(spark, sf)))


def q_neighbor_slots(spark: SparkSession, sf: str) -> DataFrame:
    return _neighbors(spark, sf).select(
        *KEYS, "in_now", "out_now", "in_before2", "out_before2", "in_before1", "out_before1",
        "in_after2", "out_after2", "in_after1", "out_after1")


def q_peak_type(spark: SparkSession, sf: str) -> DataFrame:
    return add_peak_type(slot_table(fx.taps(spark, sf), with_devices=False)).select(
        *KEYS, "is_holiday", "peak_type")


def q_peak_type_hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Slots that peak periods only partly cover."""
    slots = slot_table(fx.taps(spark, sf), slot_minutes=60, with_devices=False)
    return add_peak_type(slots, slot_minutes=60).select(*KEYS, "is_holiday", "peak_type")


def q_seasonal_stats(spark: SparkSession, sf: str) -> DataFrame:
    f = fx.features(spark, sf, with_attributes=False)
    return round_doubles(f.select(
        *KEYS, "in_whm_max", "in_whm_min", "in_whm_mean", "out_whm_max", "out_whm_min",
        "out_whm_mean", "in_wh_max", "in_wh_min", "in_wh_mean", "out_wh_mean"))


def q_line_size(spark: SparkSession, sf: str) -> DataFrame:
    cells = fx.cells(spark, sf)
    sizes = line_size(station_lines(cells))
    return add_line_size(slot_table(cells, with_devices=False), sizes).select(*KEYS, "line_size")


def q_station_degree(spark: SparkSession, sf: str) -> DataFrame:
    slots = slot_table(fx.taps(spark, sf), with_devices=False)
    return add_station_type(slots, fx.degrees(spark, sf)).select(*KEYS, "station_type")


def q_special_flag(spark: SparkSession, sf: str) -> DataFrame:
    slots = slot_table(fx.taps(spark, sf), with_devices=False)
    return add_special_flag(slots, fx.SPECIAL_IDS).select(*KEYS, "is_special")


def q_neighbor_station_flow(spark: SparkSession, sf: str) -> DataFrame:
    slots = slot_table(fx.taps(spark, sf), with_devices=False)
    out = neighbor_station_flow_by_group(slots, fx.station_groups(spark, sf),
                                         in_col="in_nums", out_col="out_nums")
    return out.select(*KEYS, "nb_in_now", "nb_out_now", "nb_in_before1", "nb_out_before1",
                      "nb_in_after1", "nb_out_after1")


def q_ratio_features(spark: SparkSession, sf: str) -> DataFrame:
    f = add_ratio_features(fx.features(spark, sf, with_attributes=False))
    return round_doubles(f.select(*KEYS, "net_now", "total_now", "in_share_now", "in_trend",
                                  "out_trend", "in_vs_week", "out_vs_week"))


def q_cohort_holiday(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(cohort(fx.frames(spark, sf, want=("train",))[0], holiday=1))


def q_degree_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Degrees from the road-map matrix: unpivoted, then summed by row."""
    slots = slot_table(fx.taps(spark, sf), with_devices=False)
    return add_station_type(slots, degree_from_edges(fx.roadmap_edges(spark, sf))).select(*KEYS, "station_type")


def q_neighbor_flow_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbour flow over the road map's edges."""
    slots = slot_table(fx.taps(spark, sf), with_devices=False)
    return neighbor_station_flow_by_edges(
        slots, fx.roadmap_edges(spark, sf), offsets=(0, -1, 1), in_col="in_nums", out_col="out_nums"
    ).select(*KEYS, "nb_in_now", "nb_out_now", "nb_in_before1", "nb_out_before1", "nb_in_after1", "nb_out_after1")


def q_roadmap_row(spark: SparkSession, sf: str) -> DataFrame:
    slots = slot_table(fx.taps(spark, sf), with_devices=False).select(*KEYS)
    return add_roadmap_row(slots, fx.roadmap_edges(spark, sf), list(range(fx.N_STATIONS)))


def q_oof_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold predictions of two base predictors (V4, R4): the mean of
    station and slot before the origin, and the day before's count."""
    rows = fx.model_rows(fx.frames(spark, sf, want=("train",))[0])
    return round_doubles(out_of_fold(rows, fx.ORIGINS, base_predictions).select(
        *KEYS, "in_nums", "out_nums", "in_mean", "out_mean", "in_last", "out_last"))


def q_blend_submission(spark: SparkSession, sf: str) -> DataFrame:
    """Fold means, a 0.6/0.4 blend and the keyed submission (M7, M8, M10) of
    the same base predictors."""
    tr, sc = fx.frames(spark, sf, staged=True)
    preds = fold_mean_blend(fx.model_rows(tr), sc, fx.ORIGINS, 0.6)
    return round_doubles(submission(fx.grid(spark, sf), preds))


def q_train_frame(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(fx.frames(spark, sf, want=("train",))[0])


def q_score_frame(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(fx.frames(spark, sf, want=("score",))[1])


def q_cohort_workday(spark: SparkSession, sf: str) -> DataFrame:
    return round_doubles(cohort(fx.frames(spark, sf, want=("train",))[0], holiday=0))


def _encode(stat):
    def q(spark: SparkSession, sf: str) -> DataFrame:
        out = fx.encoded_frame(spark, sf, stat)
        return round_doubles(out.select(*KEYS, "in_slot_enc", "out_slot_enc"))
    q.__name__ = f"q_encode_{stat}"
    return q


def q_rolling_folds(spark: SparkSession, sf: str) -> DataFrame:
    # Only dates are counted: unstaged train rows let pruning drop the rest.
    tr = fx.frames(spark, sf, want=("train",))[0]
    return fold_sizes(fx.model_rows(tr), fx.ORIGINS)


def q_naive_mae(spark: SparkSession, sf: str) -> DataFrame:
    tr = fx.frames(spark, sf, want=("train",))[0]
    return round_doubles(competition_score(tr, in_pred="in_now", out_pred="out_now",
                                           by=["service_date"]))


WEEK_COLS = ["in_whm_max", "in_whm_min", "in_whm_mean", "out_whm_max", "out_whm_min", "out_whm_mean",
             "in_wh_max", "in_wh_min", "in_wh_mean", "out_wh_mean"]


def q_seasonal_asof(spark: SparkSession, sf: str) -> DataFrame:
    """The weekly profile as of each day: earlier days only."""
    slots = _neighbors(spark, sf).repartition("station_id", "hour")
    return round_doubles(add_week_flow_asof(slots).select(*KEYS, *WEEK_COLS, "whm_days", "wh_rows"))


def q_encode_asof(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.all_rows(spark, sf)
    known = F.col("service_date") != F.lit(fx.TARGET_DATE)
    return round_doubles(encode_asof(rows, known, "slot", n_min=fx.N_MIN).select(*KEYS, "in_slot_enc", "out_slot_enc"))


def q_encode_mode_counted(spark: SparkSession, sf: str) -> DataFrame:
    """``encode_mode_station_slot`` with the median by counting passes."""
    out = fx.encoded_frame(spark, sf, "mode", group_col="station_slot", n_min=1.0, medianMaxGroups=0)
    return round_doubles(out.select(*KEYS, "in_slot_enc", "out_slot_enc"))


def q_device_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """Exact distinct devices per station-hour and station-day (hour -1), and
    whether the union of stored slot sketches is within three standard errors
    of them."""
    cells = fx.cells(spark, sf)
    stored = materialize(device_sketches(cells))  # what coarser grains read
    exact = cells.withColumn("hour", slot_hour("slot"))
    parts = []
    for by in (["station_id", "service_date", "hour"], ["station_id", "service_date"]):
        counts = exact.groupBy(*by).agg(F.count_distinct("device_id").alias("devices"))
        part = with_estimate(united(stored, *by)).join(counts, by)
        parts.append(part if "hour" in by else part.withColumn("hour", F.lit(-1)))
    both = parts[0].unionByName(parts[1])
    far = F.abs(F.col("estimate") - F.col("devices"))
    return both.select("station_id", "service_date", "hour", "devices",
                       (far <= F.ceil(3 * standard_error() * F.col("devices"))).alias("within"))


def q_slot_grid_history(spark: SparkSession, sf: str) -> DataFrame:
    return slot_grid_history(slot_table(fx.taps(spark, sf), with_devices=False))


def q_blend_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Learned weights of the two base predictors, per target: thousandths of
    the mean of station and slot, and the blend's MAE over all origin days."""
    rows = materialize(q_oof_matrix(spark, sf))
    found = []
    for side in ("in", "out"):
        w, mae = blend_weights(rows, f"{side}_nums", [f"{side}_mean", f"{side}_last"])
        found.append((f"{side}_nums", w[0], mae))
    return round_doubles(spark.createDataFrame(found, "target string, mean_weight int, mae double"))


SCREENED = ["in_now", "out_now", "in_before1", "out_before1", "in_after1", "out_after1", "in_whm_mean", "out_whm_mean"]


def q_feature_screen(spark: SparkSession, sf: str) -> DataFrame:
    return feature_screen(fx.frames(spark, sf, want=("train",))[0], SCREENED)


def q_slots_by_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """The slot table kept by file: the taps as daily CSV files, the second
    half of the month before the first, taken in by three updates."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledgers/{uuid.uuid4().hex}"
    taps, middle = fx.taps(spark, sf), F.lit("2024-01-16").cast("timestamp_ntz")
    for part in (taps.where(F.col("time") >= middle), taps.where(F.col("time") < middle)):
        write_taps_csv(part, f"{base}/files")
        ledger.update(spark, f"{base}/files", f"{base}/table")
    ledger.update(spark, f"{base}/files", f"{base}/table")  # nothing new
    return ledger.slots(spark, f"{base}/table").select(
        *KEYS, "weekday", "is_holiday", "day", "hour", "minute", "in_nums", "out_nums")


def relational_queries() -> dict:
    q = {
        "slot_counts": q_slot_counts,
        "device_uniques": q_device_uniques,
        "holiday_flag": q_holiday_flag,
        "neighbor_slots": q_neighbor_slots,
        "peak_type": q_peak_type,
        "peak_type_hourly": q_peak_type_hourly,
        "seasonal_stats": q_seasonal_stats,
        "line_size": q_line_size,
        "station_degree": q_station_degree,
        "special_flag": q_special_flag,
        "neighbor_station_flow": q_neighbor_station_flow,
        "ratio_features": q_ratio_features,
        "cohort_workday": q_cohort_workday,
        "cohort_holiday": q_cohort_holiday,
        "degree_matrix": q_degree_matrix,
        "neighbor_flow_edges": q_neighbor_flow_edges,
        "roadmap_row": q_roadmap_row,
        "oof_matrix": q_oof_matrix,
        "blend_submission": q_blend_submission,
        "train_frame": q_train_frame,
        "score_frame": q_score_frame,
        "rolling_folds": q_rolling_folds,
        "naive_mae": q_naive_mae,
    }
    for stat in ("mean", "mode", "median", "var", "skewness", "kurtosis", "prior"):
        q[f"encode_{stat}"] = _encode(stat)
    q["encode_mode_station_slot"] = q_encode_mode_station_slot
    q |= {
        "seasonal_asof": q_seasonal_asof,
        "encode_asof": q_encode_asof,
        "encode_mode_counted": q_encode_mode_counted,
        "device_sketch": q_device_sketch,
        "slot_grid_history": q_slot_grid_history,
        "blend_weights": q_blend_weights,
        "feature_screen": q_feature_screen,
        "slots_by_ledger": q_slots_by_ledger,
    }
    return q


def q_encode_mode_station_slot(spark: SparkSession, sf: str) -> DataFrame:
    """Mode over (station, slot) groups with no pseudo-counts: groups of two
    rows give 0/0 (NaN, replaced by the median of the rest) or x/0 (+-inf,
    kept), so the repair runs on real rows."""
    out = fx.encoded_frame(spark, sf, "mode", group_col="station_slot", n_min=1.0)
    return round_doubles(out.select(*KEYS, "in_slot_enc", "out_slot_enc"))
