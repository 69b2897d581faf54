"""Series operators: top rows, trailing windows, gap filling, as-of lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key; order must be total for a fixed result."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")


def trailing(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rows: int = 12) -> DataFrame:
    """Adds total and n of the last rows observations (gaps are skipped) and the previous value."""
    w = Window.partitionBy(*keys).orderBy(*order)
    span = w.rowsBetween(1 - rows, 0)
    return df.withColumns({"total": F.sum(value).over(span), "n": F.count(value).over(span), "previous": F.lag(value).over(w)})


def calendar_trailing(df: DataFrame, keys: Sequence[str], period: str, value: str, first: int, last: int) -> DataFrame:
    """Adds total and n over periods from first to last relative to the row's (12 before: -12, -1)."""
    span = Window.partitionBy(*keys).orderBy(period).rangeBetween(first, last)
    return df.withColumns({"total": F.sum(value).over(span), "n": F.count(value).over(span)})


def carried_forward(df: DataFrame, keys: Sequence[str], order: str, value: str, to: str) -> DataFrame:
    """Fills nulls with the last value before."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(to, F.last(value, ignorenulls=True).over(w))


def carried_back(df: DataFrame, keys: Sequence[str], order: str, value: str, to: str) -> DataFrame:
    """Fills nulls with the next value after."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(to, F.first(value, ignorenulls=True).over(w))


def interpolated(df: DataFrame, keys: Sequence[str], order: str, value: str, to: str, longest: int = 2) -> DataFrame:
    """Fills gaps of at most longest periods on the straight line between their neighbours (whole units)."""
    w = Window.partitionBy(*keys).orderBy(order)
    at = F.when(F.col(value).isNotNull(), F.col(order))
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    out = df.withColumns(
        {
            "_v0": F.last(value, True).over(before),
            "_t0": F.last(at, True).over(before),
            "_v1": F.first(value, True).over(after),
            "_t1": F.first(at, True).over(after),
        }
    )
    line = F.expr(f"_v0 + ((_v1 - _v0) * ({order} - _t0)) div nullif(_t1 - _t0, 0)")
    short = (F.col("_t1") - F.col("_t0") - 1) <= longest
    return out.withColumn(to, F.coalesce(F.col(value), F.when(short, line))).drop("_v0", "_t0", "_v1", "_t1")


def content_key(df: DataFrame) -> Column:
    """A digest of a row's columns.  Unlike a row number it is the same wherever the row is computed again; equal rows share it."""
    return F.md5(F.to_json(F.struct(*[df[f"`{c}`"] for c in df.columns]), {"ignoreNullFields": "false"}))


def asof_latest(left: DataFrame, right: DataFrame, keys: Sequence[str], low: Column, high: Column, order: Sequence[Column]) -> DataFrame:
    """Each left row with the first right row (by order) of its keys between low and high; left rows alone stay.

    low and high are conditions over both sides' columns; the join is an
    equi-join on the keys.  Nulls and repeated rows on the left stay as they are.
    """
    own, more = left.columns, [c for c in right.columns if c not in keys]
    row = left.withColumn("_row", content_key(left))
    best = top_per_key(row.dropDuplicates(["_row"]).join(right, list(keys)).filter(low & high), ["_row"], order).select("_row", *more)
    return row.join(best, "_row", "left").select(*own, *more)


def asof_before(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, period: str, value: str, to: str) -> DataFrame:
    """Each left row with right's last value that is not null strictly before the row's own time.

    at is left's time and period right's.  Both sides go through one sort by
    key and time, so a key with many rows on either side is no join of all
    with all; left rows without an earlier value get null, repeated ones stay.
    """
    own = left.columns
    a = left.select(*[F.col(c) for c in own], F.col(at).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.select(*keys, F.col(period).cast(left.schema[at].dataType).alias("_t"), F.lit(1).alias("_side"), F.col(value).alias("_v"))
    # At equal times left rows come first, so only earlier values are before them.
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, -1)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(to, F.last("_v", ignorenulls=True).over(w))
    return both.filter("_side = 0").select(*own, to)


def previous_period(df: DataFrame, keys: Sequence[str], period: str, value: str) -> DataFrame:
    """Adds the value of the period just before, null-safe in the keys; several values give the smallest."""
    old = df.groupBy(*keys, (F.col(period) + 1).alias("_p")).agg(F.min(value).alias("previous"))
    a, b = df.alias("a"), old.alias("b")
    on = F.col(f"a.{period}") == F.col("b._p")
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, on, "left").select("a.*", "b.previous")


def changes(df: DataFrame, keys: Sequence[str], order: str, status: str, to: str) -> DataFrame:
    """ALTA, QUEDA or ESTAVEL from the status before it in the rows at hand."""
    from tidegrain.functions.rules import status_rank

    now, old = status_rank(F.col(status)), status_rank(F.lag(status).over(Window.partitionBy(*keys).orderBy(order)))
    there = F.lag(status).over(Window.partitionBy(*keys).orderBy(order)).isNotNull()
    return df.withColumn(to, F.when(~there, "ESTAVEL").when(now > old, "ALTA").when(now < old, "QUEDA").otherwise("ESTAVEL"))
