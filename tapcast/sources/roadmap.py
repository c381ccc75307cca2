"""Road map (S4, R2): the square 0/1 adjacency matrix becomes an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def roadmap_edges_from_wide(wide: DataFrame, id_col: str | None = None) -> DataFrame:
    """Unpivot a wide matrix (one row per station, one 0/1 column per station)
    into ``(station_id, neighbor_id, weight)`` rows with a non-zero weight."""
    id_col = id_col or wide.columns[0]
    others = [c for c in wide.columns if c != id_col]
    w = wide.select(F.col(id_col).cast("int").alias("station_id"),
                    *[F.col(f"`{c}`").cast("int").alias(c) for c in others])
    long = w.unpivot(["station_id"], others, "neighbor", "weight")
    return (long.where(F.col("weight") != 0)
            .select("station_id", F.col("neighbor").cast("int").alias("neighbor_id"), "weight"))


def read_roadmap_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read the matrix file; its first (unnamed) column is the station id."""
    wide = spark.read.option("header", True).csv(path)
    return roadmap_edges_from_wide(wide, wide.columns[0])
