"""Entry 1 end to end: taps of the driver tables written as daily tap CSV
files, a road-map matrix file, then the CLI writes a submission."""
import os

from pyspark.sql import functions as F

from tapcast.plans import fixture as fx
from tapcast.plans.pipeline import main

SF = "/root/testdata/sf0.001"


def test_pipeline_cli(spark, scratch):
    taps = fx.taps(spark, SF)
    tap_dir = os.path.join(scratch, "taps")
    (taps.select(F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"),
                 F.col("line_id").alias("lineID"), F.col("station_id").alias("stationID"),
                 F.col("device_id").alias("deviceID"), "status",
                 F.lit("u").alias("userID"), F.lit(0).alias("payType"))
         .write.option("header", True).csv(tap_dir))
    nation = [(r.n_nationkey, r.n_regionkey) for r in
              spark.read.parquet(f"{SF}/nation.parquet").collect()]
    road = os.path.join(scratch, "roadmap.csv")
    with open(road, "w") as f:
        f.write("," + ",".join(str(k) for k, _ in nation) + "\n")
        for k, g in nation:
            f.write(str(k) + "," + ",".join("1" if (g2 == g and k2 != k) else "0"
                                            for k2, g2 in nation) + "\n")
    out = os.path.join(scratch, "submission")
    main(["--taps", tap_dir, "--roadmap", road, "--target", "2024-01-31", "--out", out,
          "--origins", "2024-01-17,2024-01-24", "--exclude", "2024-01-02",
          "--slot-minutes", "60", "--rounds", "3", "--fit-before", "2024-01-17"])
    sub = spark.read.option("header", True).csv(out)
    n_stations = taps.select("station_id").distinct().count()
    assert sub.count() == n_stations * 24
    assert set(sub.columns) == {"stationID", "startTime", "endTime", "inNums", "outNums"}
    assert sub.where(F.col("inNums").isNull() | F.col("outNums").isNull()).count() == 0
