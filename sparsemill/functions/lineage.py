"""Cutting the lineage of iterative plans in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset a local session takes a temporary folder; on a
    cluster that is an error, since no other machine could read it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return at or "file://" + os.path.join(tempfile.gettempdir(), f"sparsemill-{os.getuid()}")


def cut(df: DataFrame) -> DataFrame:
    """df behind a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")  # the shuffle files of this plan go once the checkpoint is written
    try:
        return df.select("*").checkpoint(eager=True)  # the setting is read where a plan is made
    finally:
        conf.set(CLEANUP, before)
