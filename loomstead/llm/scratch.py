"""Tables written in the cluster's shared checkpoint folder, to cut lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; without one, a local one if Spark runs in one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="loomstead-")
        spark.sparkContext.setCheckpointDir(named)
        atexit.register(shutil.rmtree, named.removeprefix("file://"), True)
    return named.rstrip("/")


class Scratch:
    """Parquet tables that outlive the executors that made them.

    ``save`` runs a plan once and returns a frame that reads the stored rows;
    ``drop`` removes a table that no later plan reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.at = spark, f"{folder(spark)}/loomstead-{uuid.uuid4().hex}"
        self.saved: list[tuple[DataFrame, str]] = []

    def save(self, frame: DataFrame) -> DataFrame:
        path = f"{self.at}/{len(self.saved)}"
        frame.write.parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        self.saved.append((out, path))
        return out

    def drop(self, *frames: DataFrame) -> None:
        for known, path in self.saved:
            if any(known is frame for frame in frames):
                jvm = self.spark.sparkContext._jvm
                place = jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id (long), text (null becomes empty) and uid, which tells apart rows of one doc_id."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("uid", F.monotonically_increasing_id())


def remainder(doc_id) -> F.Column:
    """crc32 of doc_id as text, modulo 5; 2 for a null id, which is held out nowhere."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(2)).cast("int")
