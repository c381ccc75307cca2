"""tapcast: slot-level demand forecasting from gate-tap records, on Spark.

Operators take and return DataFrames (or are Spark ML Estimators/Models) and
stay lazy, except where a name says that it stages a table (``stage_*``,
``materialize``) or fits a model. The names below are the public API; modules
hold the details.
"""

__version__ = "0.1.0"

from tapcast.functions.calendar import Calendar, is_holiday, iso_weekday  # noqa: E402
from tapcast.functions.slots import clock_to_slot, slot_of  # noqa: E402
from tapcast.models.boosting import (L1_DEPTH5, L1_DEPTH6, L2_DEPTH9, BoosterSpec,  # noqa: E402
                                     blend, forecast, prepare)
from tapcast.models.stacking import StackedBoosters  # noqa: E402
from tapcast.operators.base import slot_table  # noqa: E402
from tapcast.operators.encoding import (BetaTargetEncoder, BetaTargetEncoderModel,  # noqa: E402
                                        encode_frame)
from tapcast.operators.frame import (score_frame, stage_features,  # noqa: E402
                                     train_frame)
from tapcast.operators.metrics import competition_score, mae  # noqa: E402
from tapcast.operators.neighbors import (add_neighbor_slots,  # noqa: E402
                                         neighbor_station_flow_by_edges,
                                         neighbor_station_flow_by_group)
from tapcast.operators.peak import add_peak_type  # noqa: E402
from tapcast.operators.seasonal import add_week_flow  # noqa: E402
from tapcast.operators.validation import fold, fold_sizes, same_weekday_origins  # noqa: E402
from tapcast.plans.features import FeatureConfig, slot_features  # noqa: E402
from tapcast.sources.grid import read_template_csv, slot_grid  # noqa: E402
from tapcast.sources.roadmap import read_roadmap_csv  # noqa: E402
from tapcast.sources.sink import submission, write_submission  # noqa: E402
from tapcast.sources.taps import (read_taps_csv, read_taps_parquet,  # noqa: E402
                                  write_taps_parquet)
from tapcast.streaming.slot_stream import slot_counts_stream, start_slot_sink, tap_stream  # noqa: E402

__all__ = [
    "Calendar", "is_holiday", "iso_weekday", "clock_to_slot", "slot_of",
    "BoosterSpec", "L1_DEPTH5", "L1_DEPTH6", "L2_DEPTH9", "blend", "forecast", "prepare",
    "StackedBoosters", "slot_table", "BetaTargetEncoder", "BetaTargetEncoderModel",
    "encode_frame", "score_frame", "stage_features", "train_frame",
    "competition_score", "mae", "add_neighbor_slots", "neighbor_station_flow_by_edges",
    "neighbor_station_flow_by_group", "add_peak_type", "add_week_flow", "fold", "fold_sizes",
    "same_weekday_origins", "FeatureConfig", "slot_features", "read_template_csv", "slot_grid",
    "read_roadmap_csv", "submission", "write_submission", "read_taps_csv",
    "read_taps_parquet", "write_taps_parquet", "slot_counts_stream", "start_slot_sink",
    "tap_stream",
]
