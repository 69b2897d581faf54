"""Small objects of text fields, such as the provenance of a row, as maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fields(**values: Column) -> Column:
    """A map of texts; a null value is a field without one."""
    return F.create_map(*[c for k, v in values.items() for c in (F.lit(k), v.cast("string"))])


def merged(left: Column, right: Column) -> Column:
    """All fields of both; right's win, and a null object has none."""
    none = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(left, none), F.coalesce(right, none)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def as_json(x: Column) -> Column:
    """A map as JSON text, its fields by name."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(x))))
