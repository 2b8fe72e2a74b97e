"""Session helpers: the shared folder, tables written there to cut lineage, and table readers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset a local session takes a temporary one; on a
    cluster that is an error, since no other machine could read it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), f"sparsemill-{os.getuid()}")
    return at


def cut(df: DataFrame, by: str | None = None, parts: int = 0) -> DataFrame:
    """df written to the shared folder: later jobs read its files and survive the loss of executors.

    With ``by`` the files are buckets of that column, ``parts`` of them, so that joins on it read them in place; df must be
    parted in the same way. The shuffle files that df took are removed as soon as it is written; else they stay on the
    executors' disks until the driver happens to collect its garbage. (A query that another thread starts meanwhile in this
    session loses its own when it has ended, which costs time only if it is run again.) ``drop`` removes the files when they
    are superseded.
    """
    spark, name = df.sparkSession, f"cut_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        out = df.write.option("compression", "zstd")
        if by:
            out.option("path", path).format("parquet").bucketBy(parts, by).saveAsTable(name)
        else:
            out.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if by:
        out = spark.table(name)
        spark.sql(f"DROP TABLE {name}")  # the name alone: the files are at their own path
    else:
        out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove the table that ``cut`` wrote; nothing that is still to be computed may read it."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def chunk_pairs(chunks: DataFrame, key: str, chunk: str, of: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join of every chunk of a key with every chunk of the same key, each pair of chunks (lo <= hi) once.

    ``chunks`` has the number of a row's chunk and how many its key has (``of``). The sides are joined on key, lo and hi, so
    that the pairs of one hot key are spread over as many groups as it has pairs of chunks.
    """
    last = F.col(of) - 1
    return (
        chunks.withColumn("hi", F.explode(F.sequence(chunk, last))).withColumnRenamed(chunk, "lo").drop(of),
        chunks.withColumn("lo", F.explode(F.sequence(F.lit(0), F.col(chunk)))).withColumnRenamed(chunk, "hi").drop(of),
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession, rows: int = 0, rows_each: int = 150_000) -> int:
    """Partitions for so many rows: as many as the session sets, more where one would hold over ``rows_each``."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))
