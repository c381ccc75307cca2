"""A slot table kept up to date file by file.

A ledger has a row for every tap file: its size and time of change, a digest of
its lines, the service dates that it holds, and whether it counts. ``update``
looks at new, changed and vanished files only, and recomputes the dates that
they touch, from all files that hold them, by overwriting these partitions.
Late files, corrected files and repeated ones end in exactly the table that a
rebuild from all files would give:

* a corrected file touches the dates that it held and those that it holds now;
* of files with equal lines the first by path counts, the others don't;
* a date that no file holds any more is not read, though its partition stays.

The slots are written before the ledger's new version, and that before its
commit marker. After a crash anywhere the next update finds the old version,
sees the same files as new and writes the same partitions again.

The driver holds the touched dates and the paths of their files, never rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapcast.functions.calendar import service_date
from tapcast.functions.slots import SLOT_MINUTES
from tapcast.operators.base import slot_table
from tapcast.session import materialize
from tapcast.sources.taps import read_taps_csv

LEDGER = ("file string, path string, length long, changed timestamp, digest string, "
          "dates array<date>, counts boolean")


def _read(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A table that may not be there yet."""
    try:
        return spark.read.schema(ddl).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ddl)


def version(spark: SparkSession, path: str) -> int:
    """The last committed version of the ledger; 0 before the first."""
    return _read(spark, f"{path}/commits", "version int").agg(F.max("version")).first()[0] or 0


def ledger(spark: SparkSession, path: str) -> DataFrame:
    v = version(spark, path)
    return _read(spark, f"{path}/ledger/{v}", LEDGER) if v else spark.createDataFrame([], LEDGER)


def listed(spark: SparkSession, files: str) -> DataFrame:
    """(file, path, length, changed) of the tap files; no file is opened."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True)
            .load(files).select(F.col("_metadata.file_path").alias("file"), "path", "length",
                                F.col("modificationTime").alias("changed")))


def read_in(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, digest, dates) of files. The digest is that of the lines as a
    multiset, by sums that merge map-side, so a large file is read in splits."""
    line = F.xxhash64("value")
    lines = (spark.read.text(paths).groupBy(F.col("_metadata.file_path").alias("file"))
             .agg(F.concat_ws("-", F.count(F.lit(1)), F.sum(line.cast("decimal(38,0)")), F.bit_xor(line)).alias("digest")))
    days = (read_taps_csv(spark, paths, file_col="file").select("file", service_date("time").alias("d")).distinct()
            .groupBy("file").agg(F.sort_array(F.collect_list("d")).alias("dates")))
    return lines.join(days, "file", "left").withColumn("dates", F.coalesce("dates", F.array().cast("array<date>")))


def update(spark: SparkSession, files: str, path: str, slot_minutes: int = SLOT_MINUTES) -> list:
    """Bring the slot table under ``path`` up to date with the tap files under
    ``files``; the dates that were written, in order."""
    v, old = version(spark, path), ledger(spark, path)
    now = materialize(listed(spark, files))
    same = now.join(old.select("file", "length", "changed", "digest", "dates"), ["file", "length", "changed"])
    fresh = now.join(same.select("file"), "file", "left_anti")
    paths = [r["path"] for r in fresh.select("path").orderBy("path").toLocalIterator()]
    rows = same.select("file", "path", "length", "changed", "digest", "dates")
    if paths:
        rows = rows.unionByName(fresh.join(materialize(read_in(spark, paths)), "file", "left")
                                .withColumn("digest", F.coalesce("digest", F.lit("empty")))
                                .withColumn("dates", F.coalesce("dates", F.array().cast("array<date>"))))
    first = rows.groupBy("digest").agg(F.min("file").alias("lead"))
    rows = materialize(rows.join(first, "digest").withColumn("counts", F.col("file") == F.col("lead"))
                       .select("file", "path", "length", "changed", "digest", "dates", "counts"))
    # What a file gave before and what it gives now; dates of either, where these differ.
    gave = old.where("counts").select("file", "digest", F.col("dates").alias("before"))
    gives = rows.where("counts").select("file", F.col("digest").alias("digest_now"), F.col("dates").alias("after"))
    moved = gave.join(gives, "file", "full_outer").where(~F.col("digest").eqNullSafe(F.col("digest_now")))
    none = F.array().cast("array<date>")
    touched = (moved.select(F.explode(F.array_union(F.coalesce("before", none), F.coalesce("after", none))).alias("d"))
               .distinct())
    dates = sorted(r["d"] for r in touched.toLocalIterator())  # at most the days of the history
    if dates:
        hold = rows.where("counts").where(F.arrays_overlap("dates", F.array(*[F.lit(d) for d in dates])))
        paths = [r["path"] for r in hold.select("path").orderBy("path").toLocalIterator()]
        if paths:
            taps = read_taps_csv(spark, paths)
            taps = taps.where(service_date("time").isin(dates))
            (slot_table(taps, slot_minutes=slot_minutes).repartition("service_date")
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("service_date").parquet(f"{path}/slots"))
    if dates or fresh.limit(1).count() or rows.count() != old.count():
        rows.write.mode("overwrite").parquet(f"{path}/ledger/{v + 1}")
        (spark.createDataFrame([(v + 1,)], "version int").coalesce(1)
         .write.mode("append").parquet(f"{path}/commits"))
    return dates


def slots(spark: SparkSession, path: str) -> DataFrame:
    """The slot table, of the dates that the committed ledger's files hold."""
    held = ledger(spark, path).where("counts").select(F.explode("dates").alias("service_date")).distinct()
    return spark.read.parquet(f"{path}/slots").join(held, "service_date", "left_semi")
