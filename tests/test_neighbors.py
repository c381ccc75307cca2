import datetime as dt

from pyspark.sql import functions as F

from helpers import by_key, taps_df, ts
from tapcast.operators.base import slot_table
from tapcast.operators.neighbors import (add_neighbor_slots, neighbor_station_flow_by_edges,
                                         neighbor_station_flow_by_group)


def _slots(spark):
    rows = [(ts(1, 0, 0), "A", 1, 1, 1),                      # slot 0
            (ts(1, 0, 10), "A", 1, 1, 0), (ts(1, 0, 11), "A", 1, 1, 0),  # slot 1
            (ts(1, 0, 30), "A", 1, 1, 1),                     # slot 3: gap at 2
            (ts(1, 23, 50), "A", 1, 1, 1),                    # slot 143
            (ts(2, 0, 0), "A", 1, 1, 0),                      # next day slot 0
            (ts(1, 0, 10), "A", 2, 5, 1),                     # station 2 slot 1
            (ts(1, 0, 20), "A", 3, 6, 1)]                     # station 3 slot 2
    return slot_table(taps_df(spark, rows))


def test_range_offsets_gap_edges_and_day_boundary(spark):
    nb = add_neighbor_slots(_slots(spark)).where("station_id = 1").collect()
    r = by_key(nb, "service_date", "slot")
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    s0 = r[(d1, 0)]
    assert (s0.in_before1, s0.in_before2, s0.out_after1, s0.in_after2) == (0, 0, 2, 0)
    s3 = r[(d1, 3)]
    assert (s3.in_before1, s3.out_before2) == (0, 2)      # slot 2 empty, slot 1 had 2 exits
    s143 = r[(d1, 143)]
    assert (s143.in_after1, s143.out_after1, s143.in_after2) == (0, 0, 0)   # no day crossing
    n0 = r[(d2, 0)]
    assert (n0.in_before1, n0.in_before2, n0.out_now) == (0, 0, 1)


def test_before1_equals_previous_now_property(spark):
    from tapcast.plans import fixture as fx
    nb = add_neighbor_slots(slot_table(fx.taps(spark, "/root/testdata/sf0.001")))
    prev = nb.select("station_id", "service_date", (F.col("slot") + 1).alias("slot"),
                     F.col("in_now").alias("p"))
    j = nb.join(prev, ["station_id", "service_date", "slot"], "left")
    bad = j.where(F.coalesce("p", F.lit(0)) != F.col("in_before1")).count()
    assert bad == 0


def test_group_flow_equals_edge_flow(spark):
    slots = add_neighbor_slots(_slots(spark))
    groups = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "station_id int, group_id int")
    edges = spark.createDataFrame([(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b],
                                  "station_id int, neighbor_id int")
    g = neighbor_station_flow_by_group(slots, groups).select(
        "station_id", "service_date", "slot", "nb_in_now", "nb_out_now", "nb_in_before1",
        "nb_in_after1").orderBy("station_id", "service_date", "slot").collect()
    e = neighbor_station_flow_by_edges(slots, edges, offsets=(0, -1, 1)).select(
        "station_id", "service_date", "slot", "nb_in_now", "nb_out_now", "nb_in_before1",
        "nb_in_after1").orderBy("station_id", "service_date", "slot").collect()
    assert g == e
    r = by_key(g, "station_id", "slot")
    assert r[(1, 1)].nb_in_now == 1          # station 2 entered at slot 1
    assert r[(1, 1)].nb_in_after1 == 1       # station 3 entered at slot 2
    assert r[(2, 1)].nb_out_now == 2         # station 1 had 2 exits at slot 1
