"""Session settings and durable cut points."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def marketplace_session(
    app_name: str = "marketgrain",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **conf: str,
) -> SparkSession:
    """A session with the settings the jobs rely on.

    Leave ``master`` and ``shuffle_partitions`` empty on a cluster: spark-submit names the first,
    adaptive execution sizes the second.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in ``spark.checkpoint.dir``.

    A private one is made only in local mode where none is set.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="marketgrain-checkpoints-"))
    return context.getCheckpointDir()


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` once to reliable storage (``checkpoint_folder``) and continue from there.

    Used where two branches of one plan must see the very same partition numbers, and to cut the
    lineage of iterative training.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
