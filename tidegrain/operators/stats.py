"""Aggregations: modes, quartile fences, shares, leave-one-out means, votes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrain.operators.windows import top_per_key


def mode_share(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent value of each key (ties: the smallest), its count and the key's count."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("freq"))
    total = counts.withColumn("total", F.sum("freq").over(Window.partitionBy(*keys)))
    return top_per_key(total, keys, [F.desc("freq"), F.asc_nulls_last(value)])


def fenced(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows within one and a half quartile ranges and not under a quarter of the median."""
    q = df.groupBy(*keys).agg(F.percentile(value, [0.25, 0.5, 0.75]).alias("q"))
    spread = F.col("q")[2] - F.col("q")[0]
    v = F.col(value).cast("double")
    return df.join(q, list(keys)).filter((v >= F.col("q")[0] - 1.5 * spread) & (v <= F.col("q")[2] + 1.5 * spread) & (v >= 0.25 * F.col("q")[1])).drop("q")


def volatility(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Of fenced rows: n, total, sigma, cv, contaminated (cv over 0.40) and deviation (10 % of the mean at least)."""
    base = fenced(df, keys, value).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.round(F.stddev_samp(F.col(value).cast("double")), 6).alias("sigma"))
    mean = F.col("total") / F.col("n")
    cv = F.round(F.col("sigma") / F.nullif(mean, F.lit(0.0)), 6)
    floor = F.col("sigma").isNull() | (F.col("sigma") == 0) | (cv < 0.10)
    return base.withColumn("cv", cv).withColumn("contaminated", F.col("cv") > 0.40).withColumn("deviation", F.when(mean == 0, F.lit(None)).when(floor, 0.10 * mean).otherwise(F.col("sigma")))


def with_volatility(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Adds volatility()'s cv, contaminated and deviation to every row, over one partitioning by the keys."""
    w, v = Window.partitionBy(*keys), F.col(value).cast("double")
    q = df.withColumn("_q", F.percentile(value, [0.25, 0.5, 0.75]).over(w))
    spread = F.col("_q")[2] - F.col("_q")[0]
    inside = (v >= F.col("_q")[0] - 1.5 * spread) & (v <= F.col("_q")[2] + 1.5 * spread) & (v >= 0.25 * F.col("_q")[1])
    own = F.when(inside, F.col(value))
    s = q.withColumns({"_n": F.count(own).over(w), "_total": F.sum(own).over(w), "_sigma": F.round(F.stddev_samp(own.cast("double")).over(w), 6)})
    mean = F.col("_total") / F.nullif(F.col("_n"), F.lit(0))
    cv = F.round(F.col("_sigma") / F.nullif(mean, F.lit(0.0)), 6)
    floor = F.col("_sigma").isNull() | (F.col("_sigma") == 0) | (F.col("cv") < 0.10)
    out = s.withColumn("cv", cv).withColumn("contaminated", F.col("cv") > 0.40).withColumn("deviation", F.when(mean == 0, F.lit(None)).when(floor, 0.10 * mean).otherwise(F.col("_sigma")))
    return out.drop("_q", "_n", "_total", "_sigma")


def upper_median(value: str) -> Column:
    """Of a group's values, the one at position n div 2 + 1 in order."""
    v = F.array_sort(F.collect_list(value))
    return F.element_at(v, (F.floor(F.size(v) / 2) + 1).cast("int"))


def leave_out(df: DataFrame, keys: Sequence[str], cell: Sequence[str], value: str, prefix: str) -> DataFrame:
    """Adds total and n of the key's other rows, those of the same cell (key and cell columns) excluded."""
    whole, own = Window.partitionBy(*keys), Window.partitionBy(*keys, *cell)
    return df.withColumns({f"{prefix}_total": F.coalesce(F.sum(value).over(whole) - F.sum(value).over(own), F.lit(0)), f"{prefix}_n": F.count(value).over(whole) - F.count(value).over(own)})


def weighted_mean(value: Column, weight: Column) -> Column:
    """Null where the weights sum to 0."""
    return F.sum(value * weight) / F.nullif(F.sum(weight).cast("double"), F.lit(0.0))


def distinct_text(value: Column, sep: str = ", ") -> Column:
    """Distinct values in order, joined; an empty group gives an empty text."""
    return F.array_join(F.array_sort(F.collect_set(value)), sep)
