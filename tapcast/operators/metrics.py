"""Error metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mae(label: str, pred) -> Column:
    p = F.col(pred) if isinstance(pred, str) else pred
    return F.avg(F.abs(F.col(label).cast("double") - p.cast("double")))


def competition_score(df: DataFrame, in_label="in_nums", in_pred="in_pred",
                      out_label="out_nums", out_pred="out_pred", by=None) -> DataFrame:
    """Mean of the entry MAE and the exit MAE, optionally per group."""
    aggs = [mae(in_label, in_pred).alias("mae_in"), mae(out_label, out_pred).alias("mae_out")]
    g = df.groupBy(*by) if by else df
    return g.agg(*aggs).withColumn("score", (F.col("mae_in") + F.col("mae_out")) / 2)
