"""Session set-up for local runs, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "trackweave", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the folder named in ``spark.checkpoint.dir``.

    Only when nothing is configured in local mode (tests, laptops) a temporary folder is used;
    on a cluster it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not context.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-"))


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the written copy.

    Used for group-level tables that several later branches read: they are computed
    once and survive the loss of any executor.
    """
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the checkpoint folder and read it back.

    For row-level tables that several passes read: later passes scan only their columns, and
    generated values (row numbers, extraction results) stay what they were.
    """
    spark = df.sparkSession
    use_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


# Rows up to which a settled side is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def settle_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Settle ``df`` and mark it for broadcasting only if its counted size allows it."""
    settled = settle(df)
    return F.broadcast(settled) if settled.count() <= limit else settled
