"""What the engine runs on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = ("spark.master", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.ansi.enabled", "spark.driver.memory", "spark.executor.memory", "spark.checkpoint.dir")


def session() -> SparkSession:
    """The running session, or a local one."""
    return SparkSession.getActiveSession() or SparkSession.builder.master("local[*]").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


def engine_config(spark: SparkSession | None = None) -> dict[str, str]:
    spark = spark or session()
    own = dict(spark.sparkContext.getConf().getAll())
    return {"spark.version": spark.version, "parallelism": str(spark.sparkContext.defaultParallelism)} | {k: spark.conf.get(k, own.get(k, "")) for k in SETTINGS}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; one of its own in local mode if it names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or tempfile.mkdtemp(prefix="shared")).rstrip("/")
