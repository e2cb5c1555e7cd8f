"""State between micro-batches, as tables of key and time that batches join with.

A batch appends one run of new entries to each table and never rewrites the others: runs of one level are merged
into one of the next when there are ``FAN`` of them, so an entry is rewritten a few times in its life.
Entries expire against the stream time of their own group (a source partition, a customer bucket): a read filters them, a merge drops
them, and a run whose newest entry is too old for every group is dropped unread.  Work follows the keys and the rows; nothing is held per group.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.history import RETENTION_MS
from ledgerlens.operators.identity import HORIZON_MS
from ledgerlens.operators.ordering import latest_per_key
from ledgerlens.session import names_in, remove

FAN = 8
CLOCKS = "stage int, slot long, time long"
# Stages that have a clock: arrival stamps and event times of source partitions, event times of customer buckets.
ARRIVAL, PARTITION, BUCKET = 0, 1, 2


@dataclass(frozen=True)
class Table:
    """``stage`` and ``slot`` say whose clock an entry's ``at`` is compared with; it counts for ``keep`` milliseconds.

    A table without a clock is kept for good: of the rows of a ``key`` that with the highest ``version`` counts.
    """

    schema: str
    stage: int | None = None
    slot: str | None = None
    keep: int = 0
    key: tuple[str, ...] = ()


TABLES = {
    "transactions": Table("partition int, transactionId string, eventId string, at long, arrival_seq long", PARTITION, "partition", HORIZON_MS),
    "events": Table("bucket long, customerId string, eventId string, fingerprint string, at long, arrival_seq long", BUCKET, "bucket", HORIZON_MS),
    # a fact as old as the retention still counts, hence one millisecond more
    "facts": Table("bucket long, customerId string, occurred_us long, at long, arrival_seq long", BUCKET, "bucket", RETENTION_MS + 1),
}


def alive(entries: DataFrame, table: Table, clocks: DataFrame) -> DataFrame:
    """Entries that a row arriving later can still meet."""
    if table.stage is None:
        return latest_per_key(entries, table.key, [F.col("version")])
    now = clocks.where(F.col("stage") == table.stage).select(F.col("slot").alias("__slot"), F.col("time").alias("__now"))
    kept = entries.join(now, F.col(table.slot) == F.col("__slot"), "left")
    return kept.where(F.col("__now").isNull() | (F.col("__now") - F.col("at") < table.keep)).drop("__slot", "__now")


class State:
    """The tables as of one commit; ``runs`` and ``clocks`` are what the commit says about them."""

    def __init__(self, spark: SparkSession, root: str, commit: dict | None, tables: Mapping[str, Table] = TABLES) -> None:
        self.spark, self.root, self.tables = spark, root, tables
        found = (commit or {}).get("state", {})
        self.runs: list[dict] = found.get("runs", [])
        self.clocks_path: str | None = found.get("clocks")

    def clocks(self) -> DataFrame:
        return self._read([self.clocks_path] if self.clocks_path else [], CLOCKS)

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        reader = self.spark.read.schema(schema)
        return reader.parquet(*[f"{self.root}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    def entries(self, name: str, met_by: DataFrame | None = None) -> DataFrame:
        """Entries of a table that still count; a key has one at most in the identity tables, as a new one is only made when the last has expired.

        ``met_by`` are keys, and only their entries are asked for.
        """
        paths, table = [r["path"] for r in self.runs if r["table"] == name], self.tables[name]
        rows = self._read(paths, table.schema)
        if met_by is not None:
            rows = rows.join(met_by.distinct(), met_by.columns, "left_semi")
        return alive(rows, table, self.clocks()) if paths else rows

    def _place(self, batch: int, name: str) -> str:
        return f"_state/{name}/{batch}-{uuid.uuid4().hex}"

    def advanced(self, batch: int, new: Mapping[str, DataFrame], clocks: DataFrame | None = None) -> dict:
        """Write a batch's entries and clocks; returns the facts for its commit."""
        clocks = self._read([], CLOCKS) if clocks is None else clocks
        place = self._place(batch, "clocks")
        latest = self.clocks().unionByName(clocks).groupBy("stage", "slot").agg(F.max("time").alias("time"))
        seen, stages = Observation(), (PARTITION, BUCKET)
        spans = [f(F.when(F.col("stage") == s, F.col("time"))).alias(f"{n}{s}") for s in stages for n, f in (("a", F.min), ("b", F.max))]
        latest.coalesce(1).observe(seen, *spans).write.parquet(f"{self.root}/{place}")
        clock_table = self._read([place], CLOCKS)
        first, last = ({s: seen.get[f"{n}{s}"] or 0 for s in stages} for n in "ab")

        def wrote(name: str) -> list[dict]:
            table, path = self.tables[name], self._place(batch, name)
            new[name].select([c.split()[0] for c in table.schema.split(", ")]).write.parquet(f"{self.root}/{path}")
            old = [r for r in self.runs if r["table"] == name and (table.stage is None or r["newest"] + table.keep > first[table.stage])]
            return self._merged(batch, name, [*old, {"table": name, "level": 0, "path": path, "newest": last.get(table.stage, 0)}], clock_table)

        with ThreadPoolExecutor(len(new)) as pool:  # independent tables
            return {"runs": [r for runs in pool.map(wrote, new) for r in runs], "clocks": place}

    def _merged(self, batch: int, name: str, runs: list[dict], clocks: DataFrame) -> list[dict]:
        level = 0
        while True:
            full = [r for r in runs if r["table"] == name and r["level"] == level]
            if len(full) < FAN:
                return runs
            path = self._place(batch, name)
            alive(self._read([r["path"] for r in full], self.tables[name].schema), self.tables[name], clocks).write.parquet(f"{self.root}/{path}")
            for r in full:
                if r not in self.runs:  # of this batch, so no commit names it
                    remove(self.spark, f"{self.root}/{r['path']}")
            runs = [r for r in runs if r not in full] + [{"table": name, "level": level + 1, "path": path, "newest": max(r["newest"] for r in full)}]
            level += 1

    def forget(self, kept: dict) -> None:
        """Remove what the commit that followed no longer names."""
        named = {r["path"] for r in kept["runs"]} | {kept["clocks"]}
        for path in [r["path"] for r in self.runs] + ([self.clocks_path] if self.clocks_path else []):
            if path not in named:
                remove(self.spark, f"{self.root}/{path}")

    def sweep(self) -> None:
        """Remove what interrupted batches left; only while no batch runs."""
        named = {r["path"] for r in self.runs} | {self.clocks_path}
        for name in (*self.tables, "clocks"):
            for file in names_in(self.spark, f"{self.root}/_state/{name}"):
                if f"_state/{name}/{file}" not in named:
                    remove(self.spark, f"{self.root}/_state/{name}/{file}")
