import os

from pyspark.sql import functions as F

from helpers import taps_df, ts
from tapcast.operators.network import (add_roadmap_row, add_station_attributes, degree_from_edges,
                                       degree_from_groups, line_size, special_flag,
                                       station_attributes, station_lines)
from tapcast.sources.roadmap import read_roadmap_csv


def test_line_size_all_days_and_two_lines(spark):
    rows = [(ts(1, 8, 0), "A", 1, 1, 1), (ts(1, 8, 0), "A", 2, 1, 1), (ts(1, 8, 0), "A", 3, 1, 1),
            (ts(1, 8, 0), "B", 3, 1, 1), (ts(1, 8, 0), "B", 4, 1, 1),
            (ts(2, 8, 0), "C", 9, 1, 1)]                     # first seen on day two
    sizes = {r.station_id: (r.line_id, r.line_size)
             for r in line_size(station_lines(taps_df(spark, rows))).collect()}
    assert sizes == {1: ("A", 3), 2: ("A", 3), 3: ("A", 3), 4: ("B", 2), 9: ("C", 1)}
    one_day = line_size(station_lines(taps_df(spark, rows), on_date=ts(1, 8, 0).date()))
    assert one_day.where("station_id = 9").count() == 0


def test_roadmap_csv_degree(spark, scratch):
    path = os.path.join(scratch, "roadmap.csv")
    with open(path, "w") as f:
        f.write(",0,1,2,3\n0,0,1,0,0\n1,1,0,1,0\n2,0,1,0,1\n3,0,0,1,0\n")
    edges = read_roadmap_csv(spark, path)
    assert edges.count() == 6
    deg = {r.station_id: r.station_type for r in degree_from_edges(edges).collect()}
    assert deg == {0: 1, 1: 2, 2: 2, 3: 1}
    wide = add_roadmap_row(spark.createDataFrame([(1,), (7,)], "station_id int"), edges,
                           [0, 1, 2, 3]).orderBy("station_id").collect()
    assert [wide[0][f"adj_{i}"] for i in range(4)] == [1, 0, 1, 0]
    assert [wide[1][f"adj_{i}"] for i in range(4)] == [0, 0, 0, 0]


def test_group_degree_matches_pairs(spark):
    nation = spark.read.parquet("/root/testdata/sf0.01/nation.parquet")
    groups = nation.select(F.col("n_nationkey").alias("station_id"),
                           F.col("n_regionkey").alias("group_id"))
    a, b = groups.alias("a"), groups.alias("b")
    pairs = (a.join(b, (F.col("a.group_id") == F.col("b.group_id")) &
                    (F.col("a.station_id") != F.col("b.station_id")))
             .select(F.col("a.station_id").alias("station_id"),
                     F.col("b.station_id").alias("neighbor_id"), F.lit(1).alias("weight")))
    x = {r.station_id: r.station_type for r in degree_from_groups(groups).collect()}
    y = {r.station_id: r.station_type for r in degree_from_edges(pairs).collect()}
    assert x == y and set(x.values()) == {4}


def test_station_attributes_absent_station_and_special(spark):
    sizes = spark.createDataFrame([(1, "A", 3), (15, "A", 3)], "station_id int, line_id string, line_size bigint")
    degs = spark.createDataFrame([(1, 2), (2, 1)], "station_id int, station_type bigint")
    attrs = station_attributes(sizes, degs)
    assert attrs.count() == 3
    slots = spark.createDataFrame([(1, 0), (2, 0), (15, 0), (99, 0)], "station_id int, slot int")
    got = {r.station_id: (r.line_size, r.station_type, r.is_special)
           for r in add_station_attributes(slots, attrs).collect()}
    assert got == {1: (3, 2, 0), 2: (0, 1, 0), 15: (3, 0, 1), 99: (0, 0, 0)}
    n = spark.createDataFrame([(None,), (15,)], "s int").select(special_flag("s").alias("f"))
    assert [r.f for r in n.collect()] == [0, 1]
