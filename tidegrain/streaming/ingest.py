"""Incremental ingest: each micro-batch is split, merged by key and audited."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidegrain.operators.tables import prefer
from tidegrain.operators.windows import top_per_key
from tidegrain.sources import folders, versions


def merged(old: DataFrame | None, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of the batch over those of the table; the last by order counts within a batch."""
    newest = top_per_key(batch, keys, [F.desc_nulls_last(c) for c in order])
    return newest if old is None else prefer(newest, old, keys, [F.desc_nulls_last(c) for c in order])


def status_changes(old: DataFrame, new: DataFrame, keys: Sequence[str], status: str = "status") -> DataFrame:
    """Keys whose status is not what it was: before and after."""
    a = old.select(*keys, F.col(status).alias("before"))
    b = new.select(*keys, F.col(status).alias("after"))
    return a.join(b, list(keys)).filter(~F.col("before").eqNullSafe(F.col("after")))


def current(spark: SparkSession, folder: str, schema: StructType | None = None) -> DataFrame | None:
    """The table of an ingest; while no row has been accepted, no table, or an empty one of a schema that is given."""
    table = versions.read(spark, folder)
    return spark.createDataFrame([], schema) if table is None and schema is not None else table


def change_log(spark: SparkSession, folder: str) -> DataFrame | None:
    """Keys, before, after and batch of every status that an ingest changed, none before the first batch."""
    return spark.read.parquet(f"{folder}/changes").drop("number") if folders.names(spark, f"{folder}/changes") else None


def transitions(log: DataFrame) -> DataFrame:
    """How often each status became each other, and the first and last batch that did it."""
    return log.groupBy("before", "after").agg(F.count("*").alias("changes"), F.min("batch").alias("first_batch"), F.max("batch").alias("last_batch"))


def apply_batch(batch: DataFrame, number: int, folder: str, keys: Sequence[str], order: Sequence[str], check: Callable[[DataFrame], tuple[DataFrame, DataFrame]], part: Column, audit: str | None = None) -> None:
    """Merge one batch: rewrite the parts that it touches, keep rejected rows, and log what became of the audited column.

    All that a batch writes depends on the version before it and goes under
    its number, so a batch that is run again changes nothing and is logged
    once.
    """
    spark = batch.sparkSession
    good, bad = check(batch)
    good = good.withColumn("part_key", versions.part_key(part)).persist()
    try:
        touched = [r["part_key"] for r in good.select("part_key").distinct().collect()]
        before = versions.numbers(spark, folder, number)
        old = versions.read_parts(spark, folder, before[-1], touched) if before and touched else None
        new = merged(old, good.drop("part_key"), keys, order)
        if audit:
            empty = good.limit(0) if old is None else old
            log = status_changes(empty, new, keys, audit).withColumn("batch", F.lit(number).cast("long"))
            log.coalesce(max(1, len(touched) // 64)).write.mode("overwrite").parquet(f"{folder}/changes/number={number}")
        if touched:
            noted = spark.createDataFrame([(p, "") for p in touched], "part string, digest string")
            versions.commit(new.withColumn("part_key", versions.part_key(part)), folder, number, noted)
        bad.write.mode("overwrite").parquet(f"{folder}/rejected/batch={number}")
    finally:
        good.unpersist()


def start(stream: DataFrame, folder: str, checkpoint: str, keys: Sequence[str], order: Sequence[str], check: Callable[[DataFrame], tuple[DataFrame, DataFrame]], notify: Callable[[int], None] | None = None, parts: int = 16, part: Column | None = None, audit: str | None = None) -> StreamingQuery:
    """Merge a stream into a Parquet table below folder (read it with current()), with rejected rows beside it.

    part, a function of the keys, names each row's part: a month, or a range
    of keys, such that new rows touch few parts and a part is as large as one
    job should rewrite.  Without it rows are dealt over parts by a hash of the
    key, which suits small tables only, since most batches touch all of them.
    The parts must not change.  audit names a column whose changes are logged
    (read them with change_log()).

    A micro-batch writes a new version of the parts that it touches and of no
    other; the version before is kept for readers, older ones go.  A batch
    that is run again after a failure starts from the same version and gives
    the same table.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(parts)) if part is None else part

    def apply(batch: DataFrame, number: int) -> None:
        apply_batch(batch, number, folder, keys, order, check, place, audit)
        if notify:
            notify(number)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_totals(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and value sums of event types in tumbling windows, late rows up to the watermark counted."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
