"""Fixed virtual slots: records hash into thousands of slots, bytes are summed
per slot, and a versioned map says which shard holds a slot. Rebalancing edits
the map; no record is hashed anew.

The first map deals the slots, largest first, to the shard with the fewest
bytes so far, so shard sizes are near equal (law "bytes"). All steps are
DataFrame functions; the map has ``slots`` rows whatever the input.

Cases: a null text has size 1 and the checksum of no bytes; a null id hashes
like any value; repeated rows are counted and placed each; slots without rows
are in the map too; an empty table gives a map and no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Virtual slots. More than any shard count to come, few enough for one row.
SLOTS = 4096


def slot_of_key(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def records(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot): size is the text's UTF-8 bytes and one."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
                     F.crc32(text.cast("binary")).alias("text_crc32"),
                     slot_of_key(F.col(id_col).cast("long"), slots).alias("vslot"))


def slot_sizes(recs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(vslot, n, bytes) of every slot, empty ones included."""
    held = recs.groupBy("vslot").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    every = recs.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(held, "vslot", "left").na.fill(0, ["n", "bytes"])


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map: (version, vslot, shard). The slots, largest
    first, each go to the shard with the fewest bytes: one fold over an array
    of all slots (a fixed number)."""
    dealt = sizes.agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("bytes")).alias("less"), F.col("vslot")))).alias("a"))
    fold = F.expr(f"""aggregate(a,
        named_struct('loads', array_repeat(0L, {shards}), 'out', cast(array() as array<int>)),
        (acc, x) -> named_struct(
            'loads', transform(acc.loads, (v, i) -> if(i + 1 = array_position(acc.loads, array_min(acc.loads)),
                                                       v - x.less, v)),
            'out', concat(acc.out, array(int(array_position(acc.loads, array_min(acc.loads))) - 1))),
        acc -> acc.out)""")
    return (dealt.select(F.explode(F.arrays_zip(F.col("a.vslot").alias("vslot"), fold.alias("shard"))).alias("z"))
            .select(F.lit(1).alias("version"), "z.vslot", "z.shard"))


def grown_map(smap: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version with one more shard than ``shards``: from each shard,
    slots beyond its fair share of bytes move to the new one; nothing else
    moves."""
    both = smap.join(sizes, "vslot")
    by_shard = Window.partitionBy("shard")
    fair = F.sum("bytes").over(Window.partitionBy()) / F.lit(shards + 1)
    running = F.sum("bytes").over(by_shard.orderBy(F.xxhash64("vslot"), "vslot"))
    return both.select(
        (F.col("version") + 1).alias("version"), "vslot",
        F.when(running <= F.sum("bytes").over(by_shard) - fair, F.lit(shards))
        .otherwise(F.col("shard")).alias("shard"))


def save_map(smap: DataFrame, path: str) -> None:
    """Append a version to the stored maps."""
    smap.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the newest if none is named."""
    maps = spark.read.schema("vslot int, shard int, version int").parquet(path)
    if version is not None:
        return maps.where(F.col("version") == version)
    return maps.where(F.col("version") == maps.select(F.max("version")).scalar())


def placed(recs: DataFrame, sizes: DataFrame, smap: DataFrame) -> DataFrame:
    """Each record's shard and its place there, gapless from 0: what the
    shard's earlier slots hold, plus the place within its own slot."""
    before = Window.partitionBy("shard").orderBy("vslot")
    at = (smap.join(sizes, "vslot")
          .select("vslot", "shard", "version", (F.sum("n").over(before) - F.col("n")).alias("base")))
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (recs.withColumn("place", F.row_number().over(within) - 1)
            .join(F.broadcast(at), "vslot")  # one row per slot: a fixed number
            .select("doc_id", "size", "text_crc32", "shard",
                    (F.col("base") + F.col("place")).cast("long").alias("slot"), "vslot",
                    F.col("version").alias("map_version")))
