"""Same-weekday flow profile.

Group-and-merge-back is a window: max/min/mean of the current counts over
every row of the same station, weekday, hour (and minute). One window spec
serves both grains -- partitioned by (station, weekday, hour), ordered by
minute, with a RANGE frame of 0 for the minute grain and an unbounded frame
for the hour grain -- so both take one exchange and one sort. A group holds
at most weeks x slots-per-hour rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def add_week_flow(df: DataFrame, in_col: str = "in_now", out_col: str = "out_now",
                  before=None) -> DataFrame:
    """Adds in/out ``_whm_`` (station, weekday, hour, minute) max, min, mean
    and ``_wh_`` (station, weekday, hour) in max, min, mean and out mean.

    ``before``: optional date; when given, only rows before it feed the
    statistics (keeps a validation day out of its own features)."""
    spec = Window.partitionBy("station_id", "weekday", "hour").orderBy("minute")
    whm = spec.rangeBetween(0, 0)
    wh = spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    src_in, src_out = F.col(in_col), F.col(out_col)
    if before is not None:
        keep = F.col("service_date") < F.lit(before)
        src_in, src_out = F.when(keep, src_in), F.when(keep, src_out)
    cols = {
        "in_whm_max": F.max(src_in).over(whm),
        "in_whm_min": F.min(src_in).over(whm),
        "in_whm_mean": F.avg(src_in).over(whm),
        "out_whm_max": F.max(src_out).over(whm),
        "out_whm_min": F.min(src_out).over(whm),
        "out_whm_mean": F.avg(src_out).over(whm),
        "in_wh_max": F.max(src_in).over(wh),
        "in_wh_min": F.min(src_in).over(wh),
        "in_wh_mean": F.avg(src_in).over(wh),
        "out_wh_mean": F.avg(src_out).over(wh),
    }
    if before is not None:
        # A group with no earlier rows has no profile: 0, the frames'
        # convention for missing history.
        cols = {k: F.coalesce(v, F.lit(0)) for k, v in cols.items()}
    return df.withColumns(cols)


def add_week_flow_asof(df: DataFrame, in_col: str = "in_now", out_col: str = "out_now",
                       date_col: str = "service_date") -> DataFrame:
    """The same profile as of each row's day: only earlier days feed it, so it
    serves every rolling origin at once and later days change no earlier row.

    Two prefix frames ordered by day number (``RANGE`` up to the day before):
    (station, weekday, hour, minute) for the ``_whm_`` columns and (station,
    weekday, hour) for ``_wh_``. Both grow row by row and lie within the
    (station, hour) partitioning of the feature plan: no exchange, no pairs of
    rows. ``whm_days`` and ``wh_rows`` count what fed them; without any earlier
    day all statistics are 0, the frames' convention for missing history."""
    day = F.datediff(F.col(date_col), F.lit("1970-01-01").cast("date"))
    earlier = Window.unboundedPreceding, -1
    whm = Window.partitionBy("station_id", "weekday", "hour", "minute").orderBy("day_number").rangeBetween(*earlier)
    wh = Window.partitionBy("station_id", "weekday", "hour").orderBy("day_number").rangeBetween(*earlier)
    stats = {f"{side}_whm_{name}": f(c).over(whm) for side, c in (("in", in_col), ("out", out_col))
             for name, f in (("max", F.max), ("min", F.min), ("mean", F.avg))}
    stats |= {"in_wh_max": F.max(in_col).over(wh), "in_wh_min": F.min(in_col).over(wh),
              "in_wh_mean": F.avg(in_col).over(wh), "out_wh_mean": F.avg(out_col).over(wh)}
    stats = {k: F.coalesce(v, F.lit(0)) for k, v in stats.items()}
    return (df.withColumn("day_number", day)
            .withColumns({**stats, "whm_days": F.count(in_col).over(whm), "wh_rows": F.count(in_col).over(wh)})
            .drop("day_number"))
