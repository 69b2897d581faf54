"""Answers to requests, kept as long as the version of what they were made from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrain.sources import folders


class Answers:
    """Whole answers in order below a folder; pages are cut from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def page(self, request: Mapping[str, Any], version: str | int, make: Callable[[], DataFrame], order: list[str], number: int = 1, size: int = 50, where: Column | None = None) -> tuple[int, DataFrame]:
        """How many rows the request has, and one page of them in order (which must be total).

        The request's answer is made once for a version; a newer version drops
        the answers of older ones.  The rows are sorted over all tasks and
        numbered within the slice of each, so no task sees all of them.  where
        filters the kept rows: total and page are those of the rest.
        """
        key = hashlib.sha256(json.dumps(request, sort_keys=True, default=str).encode()).hexdigest()[:24]
        path = f"{self.folder}/version={version}/{key}"
        if not folders.exists(self.spark, f"{path}/slices.json"):
            for old in folders.names(self.spark, self.folder):
                if old != f"version={version}":
                    folders.drop(self.spark, f"{self.folder}/{old}")
            self._write(make(), path, [F.asc_nulls_last(c) for c in order])
        if where is not None:
            rest = self.spark.read.parquet(f"{path}/rows").filter(where)
            return rest.count(), rest.orderBy("_slice", "_place").offset((number - 1) * size).limit(size).drop("_slice", "_place")
        slices = [(r["slice"], r["rows"]) for r in self.spark.read.schema("slice int, rows long").json(f"{path}/slices.json").collect()]
        wanted, before, low, high = [], 0, (number - 1) * size, number * size
        for s, rows in sorted(slices):
            if before < high and before + rows > low:
                wanted.append((F.col("_slice") == s) & F.col("_place").between(low - before + 1, high - before))
            before += rows
        table = self.spark.read.parquet(f"{path}/rows")
        mine = F.lit(False)
        for w in wanted:
            mine = mine | w
        return before, table.filter(mine).orderBy("_slice", "_place").drop("_slice", "_place")

    def _write(self, rows: DataFrame, path: str, order: list[Column]) -> None:
        rows.sort(*order).withColumn("_slice", F.spark_partition_id()).write.mode("overwrite").parquet(f"{path}/sorted")
        placed = self.spark.read.parquet(f"{path}/sorted").withColumn("_place", F.row_number().over(Window.partitionBy("_slice").orderBy(*order)))
        placed.write.mode("overwrite").parquet(f"{path}/rows")
        sizes = self.spark.read.parquet(f"{path}/sorted").groupBy("_slice").count().collect()  # a row for each task
        folders.drop(self.spark, f"{path}/sorted")
        folders.write_text(self.spark, f"{path}/slices.json", "\n".join(json.dumps({"slice": r["_slice"], "rows": r["count"]}) for r in sizes))
