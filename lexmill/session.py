"""Session factory and the settings that operators read from the session."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "lexmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, Arrow and UTC; `master` only where the caller is not on a cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of `df` through a reliable checkpoint.

    The folder is the one the session names in spark.checkpoint.dir, which all
    executors share. Only on one machine (tests) a local folder is set where that is unset; on a cluster it is an error.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, set as the checkpoint folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "lexmill-checkpoints"))
    return context.getCheckpointDir()


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """`df` over as many partitions as the session shuffles into, for work in Python that is long for its bytes.

    Adaptive execution joins partitions that are small in bytes, which would leave such work to one task; it
    keeps a number of partitions that is asked for.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *columns)
