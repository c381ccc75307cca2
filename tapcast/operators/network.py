"""Station attributes from the network.

Every output here is one row per station, so joining it onto the slot
table cannot fan out. The joins are lazy (``dimension_join``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapcast.functions.calendar import service_date
from tapcast.operators.dimension import dimension_join


def station_lines(taps: DataFrame, on_date=None) -> DataFrame:
    """Distinct (line_id, station_id) pairs of all days, from taps or from
    ``base.tap_cells``; ``on_date`` takes them from one day instead."""
    t = taps.where(F.col("line_id").isNotNull())
    if on_date is not None:
        # Date-partitioned taps carry the partition column: filtering on it
        # prunes to one directory.
        day = F.col("service_date") if "service_date" in taps.columns else service_date("time")
        t = t.where(day == F.lit(on_date))
    return t.select("line_id", "station_id").distinct()


def line_size(station_line: DataFrame) -> DataFrame:
    """One row per station: its line and the number of stations on that line.
    A station on several lines keeps the largest line, of equal ones the first
    by name (no fan-out)."""
    per_line = station_line.groupBy("line_id").agg(F.count("station_id").alias("line_size"))
    return (station_line.join(per_line, "line_id")
            .groupBy("station_id")
            .agg(F.min_by("line_id", F.struct(-F.col("line_size"), "line_id")).alias("line_id"),
                 F.max("line_size").alias("line_size")))


def add_line_size(df: DataFrame, sizes: DataFrame) -> DataFrame:
    return (dimension_join(df, sizes.select("station_id", "line_size"), "station_id")
            .withColumn("line_size", F.coalesce("line_size", F.lit(0)).cast("bigint")))


def degree_from_edges(edges: DataFrame) -> DataFrame:
    """Row sum of the adjacency matrix per station (its number of neighbours)."""
    return edges.groupBy("station_id").agg(F.sum("weight").cast("bigint").alias("station_type"))


def degree_from_groups(groups: DataFrame, group_col: str = "group_id") -> DataFrame:
    """Degree when every station of a group is adjacent to every other one:
    group size - 1, computed without listing the pairs."""
    g = groups.select("station_id", group_col).dropDuplicates(["station_id"])
    size = g.groupBy(group_col).agg(F.count("station_id").alias("_n"))
    return (g.join(size, group_col)
            .select("station_id", (F.col("_n") - 1).cast("bigint").alias("station_type")))


def add_station_type(df: DataFrame, degrees: DataFrame) -> DataFrame:
    return (dimension_join(df, degrees.select("station_id", "station_type"), "station_id")
            .withColumn("station_type", F.coalesce("station_type", F.lit(0)).cast("bigint")))


def add_roadmap_row(df: DataFrame, edges: DataFrame, stations: list) -> DataFrame:
    """The station's road-map row as 0/1 columns ``adj_<id>`` (J20): a pivot of
    the edge list over a given, finite station list."""
    wide = (edges.groupBy("station_id").pivot("neighbor_id", stations)
            .agg(F.max("weight")).na.fill(0))
    wide = wide.select("station_id", *[F.col(f"`{s}`").cast("int").alias(f"adj_{s}") for s in stations])
    filled = {f"adj_{s}": F.coalesce(f"adj_{s}", F.lit(0)) for s in stations}
    return dimension_join(df, wide, "station_id").withColumns(filled)


def special_flag(station: Column | str = "station_id", special_ids=(15,)) -> Column:
    s = F.col(station) if isinstance(station, str) else station
    return F.coalesce(s.isin(list(special_ids)), F.lit(False)).cast("int")


def add_special_flag(df: DataFrame, special_ids=(15,)) -> DataFrame:
    return df.withColumn("is_special", special_flag("station_id", special_ids))


def station_attributes(sizes: DataFrame, degrees: DataFrame, special_ids=(15,)) -> DataFrame:
    """line_size, station_type and is_special in one row per station, so the
    slot table takes all three in a single join."""
    return (sizes.select("station_id", "line_size")
            .join(degrees.select("station_id", "station_type"), "station_id", "full_outer")
            .select("station_id",
                    F.coalesce("line_size", F.lit(0)).cast("bigint").alias("line_size"),
                    F.coalesce("station_type", F.lit(0)).cast("bigint").alias("station_type"),
                    special_flag("station_id", special_ids).alias("is_special")))


def add_station_attributes(df: DataFrame, attrs: DataFrame, special_ids=(15,)) -> DataFrame:
    """Join the station table; stations missing from it get 0 for line size
    and degree and their own special flag."""
    return (dimension_join(df, attrs.drop("is_special"), "station_id")
            .withColumns({"line_size": F.coalesce("line_size", F.lit(0)).cast("bigint"),
                          "station_type": F.coalesce("station_type", F.lit(0)).cast("bigint"),
                          "is_special": special_flag("station_id", special_ids)}))
