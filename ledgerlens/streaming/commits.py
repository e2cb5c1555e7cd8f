"""Numbered commits of a folder: what one micro-batch wrote becomes visible all at once.

A batch writes its outputs and the changes of its state under its own number and then one small
file that names them.  Readers look only at committed numbers.  A batch that failed on the way
left nothing visible and starts again from the commit before it; one that is already committed
is skipped, so every record counts once, whatever was repeated.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import names_in, read_text, write_text

FOLDER = "_commits"


class Commits:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def _path(self, batch: int) -> str:
        return f"{self.root}/{FOLDER}/{batch}.json"

    def get(self, batch: int) -> dict | None:
        text = read_text(self.spark, self._path(batch)) if batch >= 0 else None
        return None if text is None else json.loads(text)

    def put(self, batch: int, facts: dict) -> None:
        write_text(self.spark, self._path(batch), json.dumps({**facts, "batch": batch}))

    def last(self) -> int:
        """Number of the latest commit, -1 before the first."""
        return max((int(n[:-5]) for n in names_in(self.spark, f"{self.root}/{FOLDER}") if n.endswith(".json") and n[0] != "."), default=-1)

    def before(self, batch: int) -> dict | None:
        """What the batch starts from: the commit of its predecessor."""
        return self.get(batch - 1) or self.get(min(self.last(), batch - 1))

    def visible(self, name: str) -> DataFrame:
        """Rows of table ``name`` that are committed; batches follow each other, so one bound tells them (and prunes files)."""
        return self.spark.read.parquet(f"{self.root}/{name}").where(F.col("batch_id") <= self.last())
