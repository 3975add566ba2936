"""Write-ahead logs and folders of blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEADER = 64


def checksum(*fields: str) -> Column:
    return F.crc32(F.concat_ws("|", *[F.col(c).cast("string") for c in fields]).cast("binary"))


def positions(entries: DataFrame, file: str, order: list[str]) -> DataFrame:
    """Entries with their offset in their file: the sum of headers and payloads before them."""
    w = Window.partitionBy(file).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("offset", F.coalesce(F.sum(F.col("length") + HEADER).over(w), F.lit(0)))


def replay(log: DataFrame, *fields: str) -> DataFrame:
    """Entries whose header is whole; others are skipped. The order is that of (file_seq, offset)."""
    return log.where(F.col("checksum") == checksum(*fields))


def append(entries: DataFrame, path: str) -> None:
    """Add entries to a log kept as Parquet by file_seq, so that truncation drops whole folders."""
    entries.write.mode("append").partitionBy("file_seq").parquet(path)


def truncate(spark: SparkSession, path: str, before: int) -> list[str]:
    """Drop the folders of a log whose file_seq is less than ``before``; their names. Rows of other files stay as they are."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith("file_seq=")]
    old = [p for p in found if int(p.getName().split("=")[1]) < before]
    for p in old:
        fs.delete(p, True)
    return sorted(p.getName() for p in old)


def write_checkpoint(state: DataFrame, path: str, position: int) -> None:
    """Keep a state that covers all events up to a position. A folder is whole once Spark has marked it; older ones stay until dropped."""
    state.write.mode("overwrite").parquet(f"{path}/position={position}")


def load_checkpoint(spark: SparkSession, path: str) -> tuple[DataFrame | None, int]:
    """The state of the newest whole checkpoint and its position; (None, -1) without one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    whole = [int(n.split("=")[1]) for n in names if n.startswith("position=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return (spark.read.parquet(f"{path}/position={max(whole)}"), max(whole)) if whole else (None, -1)


def blob_list(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Name and length of every blob in a folder; contents aren't read, as no column of them is."""
    blobs = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return blobs.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")
