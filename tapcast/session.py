"""Session helpers: builder defaults and reliable checkpointing."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tapcast", master: str | None = None,
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Session with AQE on and the UI off.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset so the
    deployment decides; tests and the bench pass ``local[n]`` and a small
    partition count.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the deployment configured, if any."""
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        spark.sparkContext.setCheckpointDir(d)
    return d


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Use the session's ``spark.checkpoint.dir``; set ``fallback`` only when
    none is configured. Without a fallback, a ``local[...]`` session gets a
    fresh temporary folder (single machine, so local is shared); any other
    master raises, so a cluster job never writes to a machine-local folder."""
    d = checkpoint_dir(spark)
    if d:
        return d
    if fallback is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set; configure a shared folder")
        fallback = tempfile.mkdtemp(prefix="tapcast-ckpt-")
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback


#: Paths of the tables written within a ``scratch`` block.
_SCRATCH: ContextVar[list | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that ``materialize`` writes in this block (in its own thread)
    are deleted as the block ends, but for those written with ``keep``. What
    is read later must not depend on the deleted ones."""
    paths: list = []
    token = _SCRATCH.set(paths)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        conf = spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
        for p in paths:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)  # noqa: SLF001
            path.getFileSystem(conf).delete(path, True)


def materialize(df: DataFrame, sort_within: list | None = None, keep: bool = False) -> DataFrame:
    """Cut lineage: write the frame once as a Parquet table under the shared
    checkpoint folder and return a DataFrame reading it back.

    Used before a frame is read many times (encoder passes, model folds):
    a lost executor re-reads files instead of recomputing the plan, the plan
    runs once (an eager ``checkpoint()`` of an unpersisted frame runs it
    twice), and later readers get column pruning and filter pushdown.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{uuid.uuid4().hex}"
    if not keep and _SCRATCH.get() is not None:
        _SCRATCH.get().append(path)
    if sort_within:
        # Local sort (no exchange): row groups get narrow min/max ranges on
        # these columns, so later equality filters skip most of the file.
        df = df.sortWithinPartitions(*sort_within)
    df.write.mode("error").parquet(path)
    return spark.read.parquet(path)
