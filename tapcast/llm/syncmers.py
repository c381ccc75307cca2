"""Document fingerprints from closed syncmers over words.

A k-mer is a run of ``K`` words, its inner substrings are its words. It is an
anchor if its smallest inner hash lies at its first or last word: that depends
on the k-mer alone, so an edit elsewhere never moves an anchor. A fingerprint
is the list of a text's anchors (32-bit hashes, in text order, eight hex digits
each), and beside it the place of each anchor's first word (from 0). Likeness
is the Jaccard similarity of two anchor sets; two empty ones are alike.

Only from ``2 * K - 2`` words on is an anchor certain. A shorter text of at
least ``K`` words without one has all its runs of ``K / 2`` words as anchors.

All is done with array functions. Sliding minima and k-mer hashes are made by
doubling (runs of 1, 2, 4, 8 words), so work is linear in the text.

Cases: a null text is an empty one, and only a text without words has an empty
fingerprint; fewer than ``K`` words make one anchor of them all; rows with equal id and text are one
document when the next one is sought, and give a row each; a null id sorts
first; an only document is its own next; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapcast.session import materialize

#: Words of a k-mer: a power of two.
K = 8


def with_anchors(df: DataFrame, text_col: str, out: str, k: int = K) -> DataFrame:
    """Add ``out``: the text's anchors (array<int>) in text order, and
    ``out``_at: the places of their first words. Each step is a column of its
    own: a later one uses it twice."""
    t = "__sync_"
    words = F.split(F.trim(F.translate(F.lower(F.col(text_col)), "\t\n\u000b\f\r", "     ")), " +")
    df = df.withColumn(t + "h1", F.when(F.trim(F.translate(F.col(text_col), "\t\n\u000b\f\r", "     ")) != "",
                                        F.transform(words, lambda w: F.xxhash64(w)))
                       .otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn(t + "m1", F.col(t + "h1")).withColumn(t + "n", F.size(t + "h1"))

    def after(c: Column, step: int) -> Column:
        return F.slice(c, step + 1, F.greatest(F.size(c) - step, F.lit(0)))

    step = 1
    while step < k:
        h, m = F.col(f"{t}h{step}"), F.col(f"{t}m{step}")
        df = df.withColumns({
            f"{t}h{2 * step}": F.zip_with(h, after(h, step), lambda a, b: F.xxhash64(a, b)),
            f"{t}m{2 * step}": F.zip_with(m, after(m, step), lambda a, b: F.least(a, b))})
        step *= 2
    runs = F.greatest(F.col(t + "n") - (k - 1), F.lit(0))
    first = F.zip_with(F.slice(f"{t}m{k}", F.lit(1), runs), F.slice(t + "h1", F.lit(1), runs),
                       lambda m, a: F.when(m != a, m))  # null: the minimum is at the first word
    either = F.zip_with(first, after(F.col(t + "h1"), k - 1), lambda m, b: m.isNull() | (m == b))
    anchor = F.zip_with(either, F.slice(f"{t}h{k}", F.lit(1), runs),
                        lambda e, h: F.when(e, F.hash(h)))
    df = df.withColumn(t + "a", anchor)
    df = df.withColumn(t + "found", F.exists(t + "a", lambda x: x.isNotNull()))
    none = F.array().cast("array<int>")
    shorter = F.slice(f"{t}h{k // 2}", F.lit(1), F.greatest(F.col(t + "n") - (k // 2 - 1), F.lit(0)))
    df = df.withColumn(out, F.when(F.col(t + "found"), F.array_compact(t + "a"))
                       .when(F.col(t + "n") >= k, F.transform(shorter, lambda x: F.hash(x)))
                       .when(F.col(t + "n") > 0, F.array(F.hash(t + "h1")))
                       .otherwise(none))
    places = F.transform(t + "a", lambda x, i: F.when(x.isNotNull(), i))
    df = df.withColumn(out + "_at", F.when(F.col(t + "found"), F.array_compact(places))
                       .otherwise(F.transform(out, lambda x, i: i)))
    return df.drop(*[c for c in df.columns if c.startswith(t)])


def as_string(anchors: Column) -> Column:
    return F.array_join(F.transform(anchors, lambda x: F.lpad(F.lower(F.hex(
        x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def neighbours(keys: DataFrame, order: list[str]) -> DataFrame:
    """Add ``before``: the key columns (a struct) of the row before in a total
    order of the whole table; the first row has the last. Rows are dealt into
    ranges; a range's first row looks up the last row of the range before, in
    a table of one row per range."""
    row = F.struct(*keys.columns)
    ranged = materialize(keys.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    at = F.struct(*order)
    within = Window.partitionBy("__part").orderBy(*order)
    ends = (ranged.groupBy("__part").agg(F.max_by(row, at).alias("tail"))
            .withColumn("__prior", F.lag("tail").over(Window.orderBy("__part")))
            .withColumn("__prior", F.coalesce("__prior", F.last("tail").over(
                Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
            .select("__part", "__prior"))
    return (ranged.withColumn("__lag", F.lag(row).over(within)).join(F.broadcast(ends), "__part")
            .withColumn("before", F.coalesce("__lag", "__prior")).drop("__part", "__lag", "__prior"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, places, edited_places. Whole texts cross the network once; a document's
    first half and anchors go to the one before it."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    keys = docs.groupBy("doc_id", "h").agg(F.first(F.char_length("text")).alias("n"), F.count(F.lit(1)).alias("copies"))
    chain = materialize(neighbours(keys, ["doc_id", "h"]))
    repeated = chain.where("copies > 1").limit(1).count() > 0
    same = docs.doc_id.eqNullSafe(chain.doc_id) & (docs.h == chain.h)
    # Both uses of ``linked`` take the same columns of docs: one exchange.
    linked = docs.join(chain, same).select(docs.doc_id, docs.h, docs.text, chain.n, chain.before)

    donors = linked.select(F.col("before.doc_id").alias("to_id"), F.col("before.h").alias("to_h"),
                           F.expr("left(text, before.n div 2)").alias("lent"), "text")
    if repeated:
        donors = donors.dropDuplicates(["to_id", "to_h"])
    donors = with_anchors(donors, "text", "next_anchors", k).drop("text", "next_anchors_at")

    own = linked.select("doc_id", "h", "n", "text")
    both = own.join(donors, own.doc_id.eqNullSafe(donors.to_id) & (own.h == donors.to_h))
    both = both.select("doc_id", "n", "text", "next_anchors",
                       F.expr("concat(left(text, n - n div 2), lent)").alias("edited"))
    both = with_anchors(with_anchors(both, "text", "anchors", k), "edited", "edited_anchors", k)
    return both.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("anchors")).alias("fingerprint"), as_string(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
        F.col("anchors_at").alias("places"), F.col("edited_anchors_at").alias("edited_places"))
