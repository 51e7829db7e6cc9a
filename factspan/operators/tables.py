"""Frames that feed several branches, written once to the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one the cluster names; a temporary one in a local session only."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        top = tempfile.mkdtemp(prefix="factspan-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/factspan-{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """``rows`` as a parquet table, read back; it goes when the driver ends.

    The optimizer knows the table's size, and readers fetch only the columns they need.
    """
    spark = rows.sparkSession
    path = shared_folder(spark)
    rows.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(rows.schema).parquet(path)
