"""Tables in parts, where a version writes only the parts that changed.

A version's manifest names, for each part, the version that holds it.  It is
written last and is what readers follow, so a version without a manifest does
not exist: a run that died is written over.  Of each part the version before its
newest stays for readers of an older manifest.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrain.sources import folders

#: A part that is gone has no version; before is the one before.
MANIFEST = "part string, version long, digest string, before long"
#: Columns that name a row's place; part_key values begin with k_, so that they are read as text.
PLACE = ("table_version", "part_key")


def part_key(value: Column) -> Column:
    return F.concat(F.lit("k_"), F.coalesce(value.cast("string"), F.lit("")))


def numbers(spark: SparkSession, folder: str, below: int | None = None) -> list[int]:
    """Complete versions in order, of those below a number."""
    found = [int(n.split("=")[1]) for n in folders.names(spark, f"{folder}/manifest") if n.startswith("version=")]
    return [v for v in sorted(found) if (below is None or v < below) and folders.exists(spark, f"{folder}/manifest/version={v}/_SUCCESS")]


def manifest(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """part, version, digest and before of each part."""
    return spark.read.schema(MANIFEST).json(f"{folder}/manifest/version={version}")


def _read(spark: SparkSession, folder: str, parts: DataFrame, whole: bool = False) -> DataFrame | None:
    by_version: dict[int, list[str]] = {}
    for r in parts.filter("version is not null").select("part", "version").collect():  # a row for each part
        by_version.setdefault(r["version"], []).append(r["part"])
    if not by_version:
        return None
    # Both columns are folders, so the condition picks files before any is read.
    mine = reduce(lambda a, b: a | b, [(F.col("table_version") == v) & F.col("part_key").isin(keys) for v, keys in by_version.items()])
    rows = spark.read.option("basePath", f"{folder}/table").parquet(*[f"{folder}/table/table_version={v}" for v in sorted(by_version)]).filter(mine)
    return rows if whole else rows.drop(*PLACE)


def read(spark: SparkSession, folder: str, version: int | None = None, places: bool = False) -> DataFrame | None:
    """The table as of a version (the newest), with its PLACE columns if asked for; None before the first."""
    known = numbers(spark, folder)
    if not known:
        return None
    return _read(spark, folder, manifest(spark, folder, known[-1] if version is None else version), places)


def read_parts(spark: SparkSession, folder: str, version: int, keys: Sequence[str]) -> DataFrame | None:
    """Rows of some parts as of a version."""
    return _read(spark, folder, manifest(spark, folder, version).filter(F.col("part").isin(list(keys))))


def commit(changed: DataFrame, folder: str, version: int, digests: DataFrame, gone: Sequence[str] = ()) -> None:
    """Write the rows in changed (with part_key) as a version, and the manifest that takes all other parts from the version before.

    digests has part and digest of each part in changed; parts in gone have no
    rows any more.
    """
    spark = changed.sparkSession
    # A part goes to a few tasks, however many rows it has.
    changed.repartition("part_key", F.pmod(F.xxhash64(*[c for c in changed.columns if c != "part_key"]), F.lit(4))).write.mode("overwrite").partitionBy("part_key").parquet(f"{folder}/table/table_version={version}")
    known = numbers(spark, folder, version)
    old = manifest(spark, folder, known[-1]) if known else spark.createDataFrame([], MANIFEST)
    new = digests.select("part", F.lit(version).cast("long").alias("new_version"), F.col("digest").alias("new_digest")).unionByName(spark.createDataFrame([(g, None, None) for g in gone], "part string, new_version long, new_digest string"))
    both = old.join(new.withColumn("touched", F.lit(True)), "part", "full").withColumn("touched", F.coalesce("touched", F.lit(False)))
    # Of a touched part the version before goes to its readers, the one before that goes; so does a part that went last time.
    over = F.col("touched") | F.col("version").isNull()
    lost = both.filter(over & F.col("before").isNotNull()).select("part", "before").collect()
    kept = F.when(F.col("touched"), F.struct(F.col("new_version").alias("version"), F.col("new_digest").alias("digest"), F.col("version").alias("before"))).otherwise(F.struct("version", "digest", "before"))
    stays = F.col("touched") | F.col("version").isNotNull()
    both.filter(stays).select("part", kept.alias("x")).select("part", "x.*").coalesce(1).write.mode("overwrite").json(f"{folder}/manifest/version={version}")
    for r in lost:
        folders.drop(spark, f"{folder}/table/table_version={r['before']}/part_key={_escaped(r['part'])}")
    for v in known[:-1]:
        folders.drop(spark, f"{folder}/manifest/version={v}")


def _escaped(name: str) -> str:
    """A part's folder as Spark's writer names it."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or c in "\"#%'*/:=?\\\x7f{[]^" else c for c in name)


def digests(df: DataFrame, key: Column) -> DataFrame:
    """part and digest of each part's rows, whatever their order: how many, and two sums over hashes of the rows."""
    columns = sorted(df.columns)
    first, second = F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)
    sums = df.groupBy(key.alias("part")).agg(F.count("*").alias("n"), F.sum(first.cast("decimal(38,0)")).alias("a"), F.bit_xor(second).alias("b"))
    return sums.select("part", F.concat_ws(":", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")).alias("digest"))


def refresh(df: DataFrame, folder: str, by: str) -> tuple[int, list[str]]:
    """Make the table below folder equal to df, in parts by a column; gives the version and the parts it wrote.

    Only parts whose rows changed are written.  Where nothing changed there is
    no new version.  df is computed once and kept on the executors' disks
    meanwhile.
    """
    spark = df.sparkSession
    kept = df.persist(StorageLevel.DISK_ONLY)
    try:
        now = digests(kept, part_key(F.col(by)))
        known = numbers(spark, folder)
        old = manifest(spark, folder, known[-1]) if known else spark.createDataFrame([], MANIFEST)
        both = now.join(old.filter("version is not null").select("part", F.col("digest").alias("was")), "part", "full").filter(~F.col("digest").eqNullSafe(F.col("was")))
        rows = both.select("part", "digest").collect()  # a row for each changed part
        written, gone = sorted(r["part"] for r in rows if r["digest"] is not None), [r["part"] for r in rows if r["digest"] is None]
        if not rows and known:
            return known[-1], []
        version = known[-1] + 1 if known else 1
        changed = kept.withColumn("part_key", part_key(F.col(by))).filter(F.col("part_key").isin(written))
        commit(changed, folder, version, spark.createDataFrame([(r["part"], r["digest"]) for r in rows if r["digest"] is not None], "part string, digest string"), gone)
        return version, written
    finally:
        kept.unpersist()
