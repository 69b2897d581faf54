"""Files and folders by the paths that Spark's own readers take."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, none if it is not there."""
    at, fs = _at(spark, path)
    return sorted(str(x.getPath().getName()) for x in fs.listStatus(at)) if fs.exists(at) else []


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return bool(fs.exists(at))


def drop(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of a folder's files, which change whenever the files do."""
    at, fs = _at(spark, path)
    rows = fs.listStatus(at) if fs.exists(at) else []
    return ";".join(sorted(f"{x.getPath().getName()}:{x.getLen()}:{x.getModificationTime()}" for x in rows if x.isFile() and not x.getPath().getName().startswith(("_", "."))))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all."""
    at, fs = _at(spark, path)
    draft, _ = _at(spark, f"{path}.{uuid.uuid4().hex}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(at, False)
    if not fs.rename(draft, at):
        raise OSError(f"could not write {path}")


def work_folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share; a local session without it gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/work/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write a table to a work folder and read it back, which cuts its lineage; the folder's owner clears it."""
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
