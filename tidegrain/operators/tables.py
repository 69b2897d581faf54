"""Joins, grids, merges and pages of whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrain.operators.windows import content_key, top_per_key


def filtered(df: DataFrame, **wanted: Any) -> DataFrame:
    """Rows that equal each argument that is not None; a list means membership."""
    for name, x in wanted.items():
        if x is not None:
            df = df.filter(F.col(name).isin(list(x)) if isinstance(x, (list, tuple, set)) else F.col(name) == x)
    return df


def contains(df: DataFrame, column: str, part: str | None) -> DataFrame:
    """Rows whose text has part, ignoring case; % and _ stand for themselves."""
    if part is None:
        return df
    escaped = part.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return df.filter(F.col(column).ilike(f"%{escaped}%"))


def month_grid(keys: DataFrame, months: Sequence[int] = tuple(range(1, 13)), name: str = "mes") -> DataFrame:
    """Each key row once for each month; the months are a fixed short list, so no join is needed."""
    return keys.select("*", F.explode(F.array(*[F.lit(m) for m in months])).alias(name))


def missing(grid: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Grid rows that existing does not have."""
    return grid.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def prefer(first: DataFrame, second: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Union in which rows of first replace those of second with the same keys; one row for each key."""
    both = first.withColumn("_prio", F.lit(0)).unionByName(second.withColumn("_prio", F.lit(1)))
    return top_per_key(both, keys, [F.asc("_prio"), *order]).drop("_prio")


def updated(df: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """df with columns taken from new where it has the keys and a value; new has one row for a key at most."""
    changes = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    out = df.join(changes, list(keys), "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns])


def without(df: DataFrame, keys_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows for which no row of keys_table has equal keys (NOT EXISTS): a null equals nothing, so rows with one stay."""
    return df.join(keys_table.select(*keys).distinct(), list(keys), "left_anti")


def not_in(df: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """SQL's NOT IN: no row if values has a null; a row with a null key only if values has no row at all."""
    seen = values.select(F.col(key).alias("_v"))
    facts = seen.agg(F.count("*").alias("n"), F.count_if(F.col("_v").isNull()).alias("nulls"))
    n, nulls = facts.select("n").scalar(), facts.select("nulls").scalar()
    out = df.join(seen.filter("_v is not null").distinct(), F.col(key) == F.col("_v"), "left_anti")
    return out.filter((nulls == 0) & (F.col(key).isNotNull() | (n == 0)))


def cascade(df: DataFrame, levels: Sequence[tuple[DataFrame, Sequence[str]]], value: str, to: str, level: str) -> DataFrame:
    """First value found in level tables, each joined on its keys, and the number of that level (from 1)."""
    names = []
    for i, (table, keys) in enumerate(levels, 1):
        df = df.join(table.select(*keys, F.col(value).alias(f"_l{i}")), list(keys), "left")
        names.append(f"_l{i}")
    found = reduce(lambda w, i: w.when(F.col(f"_l{i}").isNotNull(), i), range(2, len(names) + 1), F.when(F.col("_l1").isNotNull(), 1))
    return df.withColumn(to, F.coalesce(*names)).withColumn(level, found).drop(*names)


def prefix_join(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """Pairs where left's text begins with right's, which is one word or more: equal first words, then the rest."""
    first = lambda c: F.split(F.lower(F.col(c)), " ")[0]
    a, b = left.withColumn("_word", first(left_name)), right.withColumn("_word", first(right_name))
    return a.join(b, "_word").filter(F.lower(F.col(left_name)).startswith(F.lower(F.col(right_name)))).drop("_word")


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 50) -> DataFrame:
    """A page of rows; order must be total."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def entity_page(df: DataFrame, key: str, number: int = 1, size: int = 50) -> DataFrame:
    """All rows of the page's entities."""
    keys = df.select(key).distinct().orderBy(F.asc_nulls_last(key)).offset((number - 1) * size).limit(size)
    return df.join(F.broadcast(keys) if size <= 10_000 else keys, key, "left_semi")


def candidates(df: DataFrame, known: DataFrame, key: str, tries: Mapping[int, Column]) -> DataFrame:
    """Each row with the first of its candidate keys that known has (null if none)."""
    own = df.columns
    df = df.withColumn("_row", content_key(df))
    ranked = df.dropDuplicates(["_row"]).select("_row", F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), c.alias("key")) for i, c in tries.items()])).alias("_c"))
    hit = ranked.join(known.select(F.col(key).alias("_known")).distinct(), F.col("_c.key") == F.col("_known"))
    best = hit.groupBy("_row").agg(F.min_by("_known", "_c.rank").alias("found"))
    return df.join(best, "_row", "left").select(*own, "found")
