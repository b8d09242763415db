"""Session set-up and lineage control."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "arealis", cores: int | str = "*", partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster pass the one you have."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    The folder is the one in ``spark.checkpoint.dir``, which all executors see. Where none is set the plan is left as it
    is: it is then computed where it is used.
    """
    if df.sparkSession.conf.get("spark.checkpoint.dir", None) is None:
        return df
    return df.checkpoint(eager=True)


def step(df: DataFrame) -> DataFrame:
    """A round's table of an iterative operator, written to the shared checkpoint folder.

    Without that the plan would double with every round. A session on one machine that names no folder gets one of its
    own; on a cluster ``spark.checkpoint.dir`` must be set.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="arealis-rounds-"))
    return df.checkpoint(eager=True)
