"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "assaylake", cpus: str = "*", shuffle: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("ASSAYLAKE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the folder that the cluster shares for checkpoints.

    That is ``spark.checkpoint.dir``, or else the checkpoint directory set on the SparkContext. A local temporary
    folder is made only under a ``local`` master; elsewhere executors would not see each other's files.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="assaylake-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that a lost executor never replays the whole chain."""
    shared_dir(df.sparkSession, "lineage")
    return df.checkpoint(eager=True)


def frozen(df: DataFrame, purpose: str) -> DataFrame:
    """Write the rows as Parquet into the cluster's shared folder and read them back.

    The table cuts the lineage, survives the loss of any executor and is column-pruned by later reads. Unlike a checkpoint it
    has a known size, from which Spark plans joins: a small one is sent to the tasks before the other side is moved.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
