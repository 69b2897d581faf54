"""Master records, and the move of every table that refers to a duplicate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrain.operators.windows import top_per_key

KEPT, MOVED, DROPPED = "KEPT", "MOVED", "DROPPED"


def category_rank(category: Column, order: Sequence[str]) -> Column:
    """Place of a category in an order of preference, unknown ones last."""
    at = F.array_position(F.array(*map(F.lit, order)), category)
    return F.when(F.coalesce(at, F.lit(0)) == 0, len(order) + 1).otherwise(at).cast("int")


def legibility(name: Column) -> Column:
    """1 for a mixed spelling, 2 for lower case, 3 for upper case."""
    return F.when(name == F.upper(name), 3).when(name == F.lower(name), 2).otherwise(1)


def elected(records: DataFrame, group: str, key: str, order: Sequence[Column], show: Sequence[str] = ()) -> DataFrame:
    """Each record with its group's master: the first by order, then by key; columns in show are the master's, prefixed master_."""
    best = top_per_key(records, [group], [*order, F.col(key).asc()])
    masters = best.select(F.col(group).alias("_group"), F.col(key).alias("master"), *[F.col(c).alias(f"master_{c}") for c in show])
    return records.join(masters, F.col(group) == F.col("_group")).drop("_group")


def key_map(election: DataFrame, key: str) -> DataFrame:
    """old and new of every record that is not its group's master."""
    return election.filter(F.col(key) != F.col("master")).select(F.col(key).alias("old"), F.col("master").alias("new"))


def fates(df: DataFrame, mapping: DataFrame, key: str, unique: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """df under its new keys, with each row's fate: KEPT, MOVED, or DROPPED where another row has the unique columns.

    Rows that had the key before come first, then the order decides.
    """
    x = df.join(mapping.withColumnsRenamed({"old": "_old", "new": "_new"}), F.col(key) == F.col("_old"), "left")
    x = x.withColumn("_moved", F.col("_new").isNotNull()).withColumn(key, F.coalesce("_new", key))
    rank = F.row_number().over(Window.partitionBy(*unique).orderBy("_moved", *order))
    fate = F.when(rank > 1, DROPPED).when(F.col("_moved"), MOVED).otherwise(KEPT)
    return x.withColumn("fate", fate).select(*df.columns, "fate")


def report(judged: DataFrame, name: str, value: str | None = None) -> DataFrame:
    """Rows of each fate in one table, and their sum of a value: what a run does, without doing it."""
    total = F.sum(value) if value else F.lit(None).cast("long")
    return judged.groupBy("fate").agg(F.count("*").alias("n"), total.alias("total")).select(F.lit(name).alias("table"), "fate", "n", "total")


def moved(judged: DataFrame) -> DataFrame:
    """The table after the move: every row but the dropped ones."""
    return judged.filter(F.col("fate") != DROPPED).drop("fate")


def pooled(df: DataFrame, mapping: DataFrame, key: str, unique: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """The table after a move that adds the rows of one key up, so that no sum changes."""
    x = df.join(mapping.withColumnsRenamed({"old": "_old", "new": "_new"}), F.col(key) == F.col("_old"), "left").withColumn(key, F.coalesce("_new", key))
    return x.groupBy(*unique).agg(*[F.sum(c).alias(c) for c in sums])
