"""Posterior (Beta) target encoding as a Spark ML Estimator/Model (E1-E10,
J18, A8-A10).

fit: per-group target sum ``n`` and count ``N`` plus the prior mean ``p``.
transform: ``Np = max(N_min - N, 0)``, ``a = p*Np + n``,
``b = (1-p)*Np + N - n`` and one statistic of Beta(a, b); an unseen group
uses ``n = p, N = 1``. A NaN result is replaced by the median of the
non-NaN results over the transformed rows.

The median is computed from (group -> row count) pairs with a weighted
percentile, because the statistic depends on the group only: memory is
bounded by the number of groups, never by the number of rows, and the
value enters the plan as a scalar subquery (no join, no driver round trip).
Beyond ``medianMaxGroups`` groups it comes from counting passes instead.

``encode_asof`` is the same encoding as of each row's date.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable,
                             DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapcast.operators.dimension import dimension_join
from tapcast.operators.quantile import exact_median
from tapcast.session import materialize

STAT_TYPES = ("mean", "mode", "median", "var", "skewness", "kurtosis")


def _div(num: Column, dem: Column) -> Column:
    """IEEE division under ANSI mode: x/0 is +-inf, 0/0 is NaN."""
    inf = F.lit(float("inf"))
    return (F.when(dem != 0, num / dem)
             .when(num > 0, inf).when(num < 0, -inf)
             .otherwise(F.lit(float("nan"))))


def beta_statistic(a: Column, b: Column, stat_type: str, prior: float | Column) -> Column:
    s = a + b
    if stat_type == "mean":
        return _div(a, s)
    if stat_type == "mode":
        return _div(a - 1, s - 2)
    if stat_type == "median":
        return _div(a - F.lit(1.0 / 3), s - F.lit(2.0 / 3))
    if stat_type == "var":
        return _div(a * b, F.pow(s, 2) * (s + 1))
    if stat_type == "skewness":
        return _div(2 * (b - a) * F.sqrt(s + 1), (s + 2) * F.sqrt(a * b))
    if stat_type == "kurtosis":
        return _div(6 * F.pow(a - b, 2) * (s + 1) - a * b * (s + 2), a * b * (s + 2) * (s + 3))
    return prior if isinstance(prior, Column) else F.lit(float(prior))


class _BetaParams(Params):
    groupCol = Param(Params._dummy(), "groupCol", "column to encode", TypeConverters.toString)
    targetCol = Param(Params._dummy(), "targetCol", "numeric target", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "encoded column", TypeConverters.toString)
    targetCols = Param(Params._dummy(), "targetCols", "numeric targets (one pass for all)",
                       TypeConverters.toListString)
    outputCols = Param(Params._dummy(), "outputCols", "encoded columns, one per target",
                       TypeConverters.toListString)
    statType = Param(Params._dummy(), "statType", "mean|mode|median|var|skewness|kurtosis|prior",
                     TypeConverters.toString)
    nMin = Param(Params._dummy(), "nMin", "prior pseudo-count floor", TypeConverters.toFloat)
    medianMaxGroups = Param(Params._dummy(), "medianMaxGroups",
                            "median by one aggregate up to this many groups, by counting passes beyond",
                            TypeConverters.toInt)
    broadcastMaxGroups = Param(Params._dummy(), "broadcastMaxGroups",
                               "broadcast the group table up to this many groups",
                               TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(statType="mean", nMin=1.0, broadcastMaxGroups=1_000_000,
                         medianMaxGroups=1_000_000)

    def _pairs(self):
        """(target, output) pairs from targetCols/outputCols or the single
        targetCol/outputCol."""
        if self.isSet("targetCols"):
            ts, os_ = self.getOrDefault("targetCols"), self.getOrDefault("outputCols")
            if len(ts) != len(os_):
                raise ValueError("targetCols and outputCols differ in length")
            return list(zip(ts, os_))
        return [(self.getOrDefault("targetCol"), self.getOrDefault("outputCol"))]


class BetaTargetEncoder(Estimator, _BetaParams, DefaultParamsWritable, DefaultParamsReadable):
    """Several targets share one group table: one aggregation, one join and
    one median subquery for all of them."""

    @keyword_only
    def __init__(self, *, groupCol=None, targetCol=None, outputCol=None, targetCols=None,
                 outputCols=None, statType="mean", nMin=1.0, broadcastMaxGroups=1_000_000,
                 medianMaxGroups=1_000_000):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "BetaTargetEncoderModel":
        g = self.getOrDefault("groupCol")
        pairs = self._pairs()
        aggs = []
        for i, (t, _) in enumerate(pairs):
            aggs += [F.sum(F.col(t).cast("double")).alias(f"_sum{i}"),
                     F.count(t).cast("double").alias(f"_cnt{i}")]
        stats = materialize(dataset.groupBy(g).agg(*aggs))
        # Prior = mean target over all non-null targets (every group, the
        # null group included), read from the small group table.
        tot = stats.agg(*[F.sum(f"_sum{i}").alias(f"n{i}") for i in range(len(pairs))],
                        *[F.sum(f"_cnt{i}").alias(f"N{i}") for i in range(len(pairs))],
                        F.count(F.lit(1)).alias("groups")).first()
        priors = [float(tot[f"n{i}"] / tot[f"N{i}"]) if tot[f"N{i}"] else float("nan")
                  for i in range(len(pairs))]
        model = BetaTargetEncoderModel(stats=stats.where(F.col(g).isNotNull()),
                                       priors=priors, n_groups=int(tot["groups"]))
        return self._copyValues(model)


class _ModelWriter(MLWriter):
    """Params, priors and group count as params metadata; the group table as
    Parquet next to it."""

    def __init__(self, instance: "BetaTargetEncoderModel"):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        m = self.instance
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession,
                                         extraMetadata={"priors": m.priors, "n_groups": m.n_groups})
        m.stats.write.mode("overwrite" if self.shouldOverwrite else "error").parquet(f"{path}/stats")


class _ModelReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> "BetaTargetEncoderModel":
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stats = self.sparkSession.read.parquet(f"{path}/stats")
        model = self.cls(stats=stats, priors=meta["priors"], n_groups=meta["n_groups"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model


class BetaTargetEncoderModel(Model, _BetaParams, MLWritable, MLReadable):
    def __init__(self, stats: DataFrame | None = None, priors=None, n_groups: int = 0):
        super().__init__()
        self.stats = stats
        self.priors = list(priors or [])
        self.n_groups = n_groups

    @property
    def prior(self) -> float:
        return self.priors[0]

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader(cls)

    def _lookup(self) -> DataFrame:
        limit = self.getOrDefault("broadcastMaxGroups")
        # Size checked at fit time: broadcast only a table known to be small,
        # otherwise a shuffled join.
        return F.broadcast(self.stats) if self.n_groups <= limit else self.stats

    def _value(self, n: Column, N: Column, prior: float | None = None) -> Column:
        prior = self.priors[0] if prior is None else prior
        p = F.lit(prior)
        unseen = n.isNull()
        n = F.when(unseen, p).otherwise(n)
        N = F.when(unseen, F.lit(1.0)).otherwise(N)
        Np = F.greatest(F.lit(self.getOrDefault("nMin")) - N, F.lit(0.0))
        a = p * Np + n
        b = (1 - p) * Np + N - n
        return beta_statistic(a, b, self.getOrDefault("statType"), prior)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        g = self.getOrDefault("groupCol")
        pairs = self._pairs()
        lookup = self._lookup()
        vals = [self._value(F.col(f"_sum{i}"), F.col(f"_cnt{i}"), self.priors[i])
                for i in range(len(pairs))]
        # Median of the non-NaN values over the rows of ``dataset``, weighted
        # by rows per group; one subquery returns the medians of all targets.
        # All values NaN: the median of nothing is NaN, as in NumPy.
        per_group = (dataset.groupBy(g).agg(F.count(F.lit(1)).alias("_rows"))
                     .join(lookup, g, "left")
                     .select("_rows", *[v.alias(f"_v{i}") for i, v in enumerate(vals)]))
        nan = F.lit(float("nan"))
        if self.n_groups > self.getOrDefault("medianMaxGroups"):
            # So many groups would be one task's hash table: count instead.
            per_group = materialize(per_group)
            found = [exact_median(per_group.where(~F.isnan(f"_v{i}")), f"_v{i}", "_rows") for i in range(len(pairs))]
            medians = F.struct(*[(nan if m is None else F.lit(m)).alias(f"m{i}") for i, m in enumerate(found)])
        else:
            medians = per_group.select(F.struct(*[
                F.coalesce(F.percentile(F.when(~F.isnan(f"_v{i}"), F.col(f"_v{i}")), 0.5,
                                        F.col("_rows")), nan).alias(f"m{i}")
                for i in range(len(pairs))]).alias("m")).scalar()
        # The struct sits in one column, so the plan holds one subquery.
        keyed = dataset.join(lookup, g, "left").withColumns(
            {**{f"_v{i}": v for i, v in enumerate(vals)}, "_med": medians})
        return (keyed.withColumns({
                    out: F.when(F.isnan(f"_v{i}"), F.col("_med").getField(f"m{i}"))
                          .otherwise(F.col(f"_v{i}"))
                    for i, (_, out) in enumerate(pairs)})
                .drop("_med", *[f"_v{i}" for i in range(len(pairs))],
                      *[f"_sum{i}" for i in range(len(pairs))],
                      *[f"_cnt{i}" for i in range(len(pairs))]))


def encode_frame(all_rows: DataFrame, train_rows: DataFrame, group_col: str = "slot",
                 targets=(("in_nums", "in_slot_enc"), ("out_nums", "out_slot_enc")),
                 stat_type: str = "mean", n_min: float = 300.0, **options) -> DataFrame:
    """Both targets encoded against the same group column, fitted on the
    train rows and applied to every row (one encoder, one pass)."""
    enc = BetaTargetEncoder(groupCol=group_col, targetCols=[t for t, _ in targets],
                            outputCols=[c for _, c in targets], statType=stat_type,
                            nMin=float(n_min), **options).fit(train_rows)
    return enc.transform(all_rows)


def encode_asof(rows: DataFrame, known: Column, group_col: str = "slot",
                targets=(("in_nums", "in_slot_enc"), ("out_nums", "out_slot_enc")),
                stat_type: str = "mean", n_min: float = 300.0, date_col: str = "service_date") -> DataFrame:
    """Every row encoded by its group's target sums and counts, and by the
    prior, of earlier dates only; ``known`` says which rows have a target.

    Rows are first reduced to one per (group, date), of those that only ask as
    well as of those that tell, so the last date before a row's is the frame up
    to the preceding row of its group: prefix sums in one window, no range join
    and no pairs of rows. A group-date's sums come back by an equality join.
    The prior is a prefix over one row per date.

    A group without earlier rows has the statistic of the prior alone; without
    any earlier date the prior is 0. NaN becomes the prior, so no row depends
    on others of its date. Rows with a null group are unseen."""
    sums = []
    for i, (t, _) in enumerate(targets):
        told = F.when(known, F.col(t))
        sums += [F.sum(told.cast("double")).alias(f"_s{i}"), F.count(told).cast("double").alias(f"_c{i}")]
    per = materialize(rows.groupBy(F.col(group_col).alias("_g"), F.col(date_col).alias("_d")).agg(*sums))
    names = [f"_{k}{i}" for i in range(len(targets)) for k in "sc"]
    before = Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    totals = per.groupBy("_d").agg(*[F.sum(c).alias(c) for c in names])  # one row a date
    priors = totals.select("_d", *[
        F.coalesce(F.sum(f"_s{i}").over(before) / F.nullif(F.sum(f"_c{i}").over(before), F.lit(0.0)), F.lit(0.0)).alias(f"_p{i}")
        for i in range(len(targets))])
    own = Window.partitionBy("_g").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    past = per.where(F.col("_g").isNotNull()).select("_g", "_d", *[F.coalesce(F.sum(c).over(own), F.lit(0.0)).alias(c)
                                                                   for c in names])
    joined = (dimension_join(rows.withColumn("_d", F.col(date_col)), priors, "_d")
              .withColumn("_g", F.col(group_col)).join(past, ["_g", "_d"], "left"))
    out = {}
    for i, (_, c) in enumerate(targets):
        p, seen = F.col(f"_p{i}"), F.coalesce(F.col(f"_c{i}"), F.lit(0.0)) > 0
        n, count = F.when(seen, F.col(f"_s{i}")).otherwise(p), F.when(seen, F.col(f"_c{i}")).otherwise(F.lit(1.0))
        more = F.greatest(F.lit(float(n_min)) - count, F.lit(0.0))
        value = beta_statistic(p * more + n, (1 - p) * more + count - n, stat_type, p)
        out[c] = F.when(F.isnan(value), p).otherwise(value)
    return joined.withColumns(out).select(*rows.columns, *out)
