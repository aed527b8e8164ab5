"""Session defaults and the durable cut point used by iterative plans."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "geoledger", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans rely on; cluster settings come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; one is invented only for a local master without one."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    existing = context._jsc.sc().getCheckpointDir()
    if existing.isDefined():
        return existing.get()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(os.path.join(tempfile.mkdtemp(prefix="geoledger-"), "checkpoints"))
    return context._jsc.sc().getCheckpointDir().get()


def spread(df: DataFrame) -> DataFrame:
    """``df`` for joins that are shuffled whatever the planner makes of its size.

    Sizes are guessed from compressed files and do not count what is exploded from a row, so a table of millions of rows
    would pass for one that is small enough to be sent through the driver.
    """
    return df.hint("merge")


def cut_spread(df: DataFrame) -> DataFrame:
    """``cut`` for tables that grow with the map: joins with them are shuffled."""
    return spread(cut(df))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and go on from there.

    The table survives lost executors, ends the lineage, and unlike a checkpointed RDD it is compressed, can be read
    column by column and has a known size, from which the planner chooses join strategies.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
