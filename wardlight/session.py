"""Session helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "wardlight", cores: str = "8") -> SparkSession:
    """A session for tests and the bench; a cluster job brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cores if cores != "*" else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``.

    Only a session on one machine (``local``, as in tests) may do without: it gets a folder
    of its own. On a cluster a machine-local folder would be unreadable elsewhere, so a
    missing setting is an error there.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="wardlight-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in reliable storage and cut its lineage.

    Used where a result is read many times (model searches, pair statistics), so that a
    lost executor re-reads files instead of repeating joins and windows.
    """
    scratch_path(df.sparkSession)
    return df.checkpoint()
