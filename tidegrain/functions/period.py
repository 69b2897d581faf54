"""Year-month periods as expressions.  A period number is year * 12 + month."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(year: Column, month: Column) -> Column:
    return (year * 12 + month).cast("int")


def text(year: Column, month: Column) -> Column:
    """YYYY-MM, which sorts as the periods do."""
    return F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"))


def split(period: Column) -> tuple[Column, Column]:
    """Year and month of YYYY-MM; null where a part is no number."""
    return F.split_part(period, F.lit("-"), F.lit(1)).try_cast("int"), F.split_part(period, F.lit("-"), F.lit(2)).try_cast("int")


def within_last(period: Column, newest: Column | int, months: int) -> Column:
    """The months periods up to newest."""
    newest = newest if isinstance(newest, Column) else F.lit(newest)
    return (period > newest - months) & (period <= newest)


def coherent(period: Column, year: Column, month: Column) -> Column:
    """Whether a period text is the one of its year and month."""
    return period.eqNullSafe(text(year, month)) & month.between(1, 12)


def before(as_of: Column, days: int) -> Column:
    """A retention cutoff: the date or time days before as_of."""
    return as_of - F.expr(f"INTERVAL '{int(days)}' DAY")
