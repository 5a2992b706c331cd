"""Partitions for work that is heavy for its bytes, and results kept in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def spread(frame: DataFrame) -> DataFrame:
    """The frame in at least as many partitions as the cluster has cores. Only inputs of fewer partitions than cores, small ones, are moved.

    For scans; a frame with a shuffle would be run here to count its partitions (see `distinct`).
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame if frame.rdd.getNumPartitions() >= cores else frame.repartition(2 * cores)


def distinct(frame: DataFrame) -> DataFrame:
    """The distinct rows, in as many partitions as the session sets for shuffles, which aren't joined again: for costly work on few bytes. One shuffle."""
    n = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frame.repartition(n, *frame.columns).distinct()


def shared_folder(frame: DataFrame) -> str:
    """The folder that all executors share, as the session names it; only where none is named, as in tests, a temporary one is made and named."""
    context = frame.sparkSession.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or frame.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="engine-")
        frame.sparkSession.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(frame: DataFrame) -> DataFrame:
    """The frame with its lineage cut by a checkpoint in the shared folder."""
    context = frame.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(frame))
    return frame.checkpoint()


def written(frame: DataFrame) -> DataFrame:
    """The frame written once as Parquet in the shared folder and read from there, for results that are read more than once; it outlives executors."""
    path = f"{shared_folder(frame)}/engine-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Asks the driver to collect its garbage, so that executors delete the shuffle files of frames that are written and dropped; else they stay as long as it has memory."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clear_written(spark: SparkSession) -> None:
    """Deletes what `written` has left in the shared folder; for the end of a job."""
    folder = shared_folder(spark.range(1))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in fs.globStatus(path(f"{folder}/engine-*")) or []:
        fs.delete(found.getPath(), True)
