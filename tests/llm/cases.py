"""Shared inputs: documents with every awkward case, and real ones."""
import duckdb
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x" for i in range(30000))
ROWS = [
    (None, "a null id has a text of its own"), (1, None), (2, ""), (3, LONG),
    (4, "one two three four five six seven"), (4, "one two three four five six seven"),
    (4, "another text of the same id"), (5, "one two three four five six seven"),
    (2**53 + 1, "a large id"), (2**53 + 3, "another large id"), (6, "!!! ???"), (7, "für 漢字 ñandú 🙂 ½ it's"), (8, "word"), (9, " \t\n "), (None, None),
]
CLASHING = ["h", "g", "node", "score", "shard", "slot", "start", "length", "label", "rest", "count", "k", "__h", "row", "id", "xh", "salt"]


def awkward(spark, rows=ROWS):
    """The rows with extra columns whose names operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit(f"extra {c}") for c in CLASHING})


def empty(spark):
    return awkward(spark, [])


def real(table="documents"):
    return duckdb.sql(f"select * from '{SF}/{table}.parquet' order by 1").fetchall()


def texts():
    return {r[0]: r[1] or "" for r in duckdb.sql(
        f"select doc_id, text from '{SF}/documents.parquet' order by 1").fetchall()}
