"""Joins against small derived tables (one row per station, per date, per
group). Nothing runs while the plan is built: adaptive execution sees the
derived table's real size and broadcasts it under Spark's own byte limit, or
else keeps a shuffled join, whose skewed partitions it splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def dimension_join(big: DataFrame, small: DataFrame, on, how: str = "left") -> DataFrame:
    return big.join(small, on, how)
