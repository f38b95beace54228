"""Cutting the lineage of iterative operators with Parquet tables in the session's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only a session on one machine (a local master) may go without and gets a folder of its own; elsewhere that raises,
    since executors could not read each other's files.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="tessera-")
        context.setCheckpointDir(folder)
        folder = context.getCheckpointDir()
    return folder


def settled(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """`df` as a table: written once and read back, so that it survives lost executors.

    Unlike a checkpoint it does not carry the size estimates of its plan on, which multiply at every join of a loop.
    spent: frames of earlier rounds, from here, that nothing reads any more; their files go.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_path = path
    forget(*spent)
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the files of frames from settled()."""
    for frame in frames:
        delete(frame.sparkSession, frame._settled_path)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
