"""A load as steps whose results are kept, so that it goes on where it stopped.

A step's version is a digest of its name, its parameters and the versions of
the steps (or sources) that it reads.  Its table is written first and noted in
the ledger then; a step that the ledger has in this version is read and not
computed, and one that died on the way is written over.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidegrain.sources import folders


class Steps:
    """Tables by name, each made when it is first asked for."""

    def __init__(self, spark: SparkSession, folder: str, source: str):
        """source tells versions of the input apart."""
        self.spark, self.folder, self.source = spark, folder, source
        self.made: dict[str, tuple[Sequence[str], Callable[..., DataFrame], str]] = {}
        #: Steps that this object has computed, in order.
        self.ran: list[str] = []

    def add(self, name: str, needs: Sequence[str], make: Callable[..., DataFrame], **parameters) -> None:
        """A step that make computes from the tables of the steps in needs; another parameter is another version."""
        unknown = [n for n in needs if n not in self.made]
        if unknown or name in self.made:
            raise ValueError(f"step {name} is there already" if name in self.made else f"step {name} needs unknown steps {unknown}")
        self.made[name] = (needs, make, json.dumps(parameters, sort_keys=True, default=str))

    def version(self, name: str) -> str:
        needs, _, parameters = self.made[name]
        text = "\n".join([name, parameters, *(self.version(n) for n in needs)] if needs else [name, parameters, self.source])
        return hashlib.sha256(text.encode()).hexdigest()[:24]

    def table(self, name: str) -> DataFrame:
        """A step's table, from the ledger if it is there."""
        version = self.version(name)
        path, entry = f"{self.folder}/steps/{name}/{version}", f"{self.folder}/ledger/{name}={version}.json"
        if not folders.exists(self.spark, entry):
            needs, make, _ = self.made[name]
            began, seen = time.time(), Observation()
            make(*[self.table(n) for n in needs]).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
            row = {"step": name, "version": version, "rows": seen.get["rows"], "seconds": round(time.time() - began, 3), "finished_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
            folders.write_text(self.spark, entry, json.dumps(row))
            self.ran.append(name)
        return self.spark.read.parquet(path)

    def ledger(self) -> DataFrame:
        """step, version, rows, seconds and finished_at of every step that ended."""
        return self.spark.read.schema("step string, version string, rows long, seconds double, finished_at string").json(f"{self.folder}/ledger")
