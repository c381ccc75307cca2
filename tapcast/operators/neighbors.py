"""Adjacent-slot and neighbour-station features.

The slot table is sparse, so an earlier slot is found by *value* (a RANGE
frame at a fixed offset), never by position (``lag`` would pick the
previous non-empty slot). Partitions are (station, date) -- the same
partitioning the base slot table already has, so no exchange is added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapcast.operators.dimension import dimension_join


def add_neighbor_slots(slots: DataFrame, lags=(1, 2), leads=(1, 2),
                       in_col: str = "in_nums", out_col: str = "out_nums") -> DataFrame:
    """Rename the counts to ``in_now``/``out_now`` and add ``in_before{i}``,
    ``out_before{i}``, ``in_after{j}``, ``out_after{j}``: the counts of the
    same station and day ``i`` slots earlier / ``j`` slots later, 0 when that
    slot had no taps. Day boundaries are never crossed."""
    w = Window.partitionBy("station_id", "service_date").orderBy("slot")
    df = slots.withColumnsRenamed({in_col: "in_now", out_col: "out_now"})
    cols = {}
    for i in sorted(lags, reverse=True):
        f = w.rangeBetween(-i, -i)
        cols[f"in_before{i}"] = F.coalesce(F.sum("in_now").over(f), F.lit(0)).cast("bigint")
        cols[f"out_before{i}"] = F.coalesce(F.sum("out_now").over(f), F.lit(0)).cast("bigint")
    for j in sorted(leads, reverse=True):
        f = w.rangeBetween(j, j)
        cols[f"in_after{j}"] = F.coalesce(F.sum("in_now").over(f), F.lit(0)).cast("bigint")
        cols[f"out_after{j}"] = F.coalesce(F.sum("out_now").over(f), F.lit(0)).cast("bigint")
    return df.withColumns(cols)


def neighbor_station_flow_by_group(df: DataFrame, groups: DataFrame,
                                   group_col: str = "group_id", offsets=(0, -1, 1),
                                   in_col: str = "in_now", out_col: str = "out_now") -> DataFrame:
    """Flow of the *other* stations of the same group at the same slot and at
    adjacent slots, for networks where a group's stations are all adjacent.

    ``groups`` maps station_id -> group (one row per station). The total of a
    group at slot s+k comes from a RANGE frame over (group, date); the
    station's own count at s+k is subtracted, so no station pairs are ever
    formed. A (group, date) partition holds at most stations x slots rows.
    """
    g = groups.select("station_id", F.col(group_col).alias("_grp")).dropDuplicates(["station_id"])
    x = dimension_join(df, g, "station_id")
    w = Window.partitionBy("_grp", "service_date").orderBy("slot")
    # The station determines its group, so (group, station, date) is the same
    # split as (station, date) and reuses the (group, date) partitioning.
    own = Window.partitionBy("_grp", "station_id", "service_date").orderBy("slot")
    cols = {}
    for k in offsets:
        name = "now" if k == 0 else (f"before{-k}" if k < 0 else f"after{k}")
        for src, pre in ((in_col, "nb_in"), (out_col, "nb_out")):
            total = F.coalesce(F.sum(src).over(w.rangeBetween(k, k)), F.lit(0))
            mine = F.coalesce(F.sum(src).over(own.rangeBetween(k, k)), F.lit(0))
            val = F.when(F.col("_grp").isNull(), F.lit(0)).otherwise(total - mine)
            cols[f"{pre}_{name}"] = val.cast("bigint")
    return x.withColumns(cols).drop("_grp")


def neighbor_station_flow_by_edges(df: DataFrame, edges: DataFrame, offsets=(0,),
                                   in_col: str = "in_now", out_col: str = "out_now") -> DataFrame:
    """Same features from an explicit road-map edge list ``(station_id,
    neighbor_id)``. A metro map has a small bounded degree, so the edge join
    multiplies the slot rows by at most that degree before the re-aggregation."""
    e = edges.select("station_id", "neighbor_id").dropDuplicates()
    names = {k: "now" if k == 0 else (f"before{-k}" if k < 0 else f"after{k}") for k in offsets}
    # A neighbour's slot s+k contributes to this station's slot s: its row is
    # exploded over the offsets, joined once and summed once for all of them.
    flows = df.select(F.col("station_id").alias("neighbor_id"), "service_date",
                      F.explode(F.array(*[F.lit(k) for k in offsets])).alias("_k"),
                      F.col("slot").alias("_slot"), F.col(in_col).alias("_in"), F.col(out_col).alias("_out"))
    contrib = (dimension_join(flows, e, "neighbor_id", "inner")
               .groupBy("station_id", "service_date", (F.col("_slot") - F.col("_k")).alias("slot"))
               .agg(*[F.sum(F.when(F.col("_k") == k, F.col(src))).alias(f"{pre}_{n}")
                      for k, n in names.items() for src, pre in (("_in", "nb_in"), ("_out", "nb_out"))]))
    cols = [f"{pre}_{n}" for n in names.values() for pre in ("nb_in", "nb_out")]
    return (df.join(contrib, ["station_id", "service_date", "slot"], "left")
            .withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in cols}))
