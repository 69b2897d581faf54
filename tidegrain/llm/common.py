"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and U+0009 to U+000D.
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"

#: Rows of an Arrow batch, so that a batch of long texts stays small.
ROWS_PER_BATCH = 256


def words(text: Column) -> Column:
    """Words of a text (null: none)."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_SEPARATORS)
    return F.filter(parts, lambda w: w != "")


def small_batches(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch unless they are already lower."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))


def shared_folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share.

    Only a local session without that setting gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            base = current
        elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            base = tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"


#: Folders of the tables that stored() has written and nothing has deleted yet.
_made: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts its lineage."""
    path = shared_folder(df.sparkSession)
    _made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _made:
        _made.remove(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        name = folder.rsplit("/", 1)[-1]
        for path in [x for x in _made if x.endswith(name)] or [folder]:
            _delete(df.sparkSession, path)


def settled(make) -> DataFrame:
    """make()'s result as a stored table; the tables stored on the way are deleted."""
    before = set(_made)
    made = make()
    spark = made.sparkSession
    out = stored(made)
    for path in [x for x in _made[:-1] if x not in before]:
        _delete(spark, path)
    return out


def quoted(name: str) -> str:
    """A column's name as Spark parses it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
