"""Tables that change together: a version names the files of every one of them, so a scan of several is consistent.

Writing some of the tables makes a new version in which the others keep their files.  A reader takes one version for all its
tables; what a writer is doing meanwhile, or left half done, is not in it.  Schemas are declared: a stored table that differs is refused
when the version is opened, not somewhere in a plan.  Scans are plain Parquet scans, so filters and columns reach the files.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerlens.streaming.commits import Commits

# Columns of the governance tables, as the table jobs read them.
GOVERNANCE: Mapping[str, str] = {
    "proposals": "head_key string, rule_id string, rule_version_id string, change_type string, definition string, author string, proposal_seq long",
    "versions": "head_key string, rule_id string, rule_version_id string, change_type string, definition string, author string, proposal_seq long, "
                "reject_reason string, version_number int",
    "decision_log": "decision_seq long, rule_version_id string, decision string, approver string",
    "decided": "head_key string, decision_seq long, rule_version_id string, rule_id string, change_type string, decision string, author string, "
               "approver string, outcome string, reason string, ruleset_version long, items array<string>",
    "snapshots": "head_key string, ruleset_version long, snapshot_id string, approved_change string, content_hash string, created_at string, "
                 "payload string, payload_bytes int",
    "outbox": "aggregate_id string, aggregate_version long, canonical_payload string, status string, attempt_count int, next_attempt_us long",
    "audit": "actor string, action string, outcome string, entity_id string, at_seq long, entity_type string, audit_event_id string",
}


class SchemaMismatch(ValueError):
    """A stored or given table does not have the declared columns."""


def _fields(schema: T.StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


class Stored:
    """The tables below ``root`` as of one version, the latest unless a number is given; -1 is the empty beginning."""

    def __init__(self, spark: SparkSession, root: str, schemas: Mapping[str, str] = GOVERNANCE, version: int | None = None) -> None:
        self.spark, self.root, self._commits = spark, root, Commits(spark, root)
        self.schemas = {name: T.StructType.fromDDL(s) for name, s in schemas.items()}
        self.version = self._commits.last() if version is None else version
        found = self._commits.get(self.version)
        if found is None and self.version >= 0:
            raise LookupError(f"no version {self.version}")
        self._tables: dict[str, dict] = (found or {}).get("tables", {})
        for name, stored in self._tables.items():
            if name in self.schemas and stored["columns"] != [list(f) for f in _fields(self.schemas[name])]:
                raise SchemaMismatch(f"{name}: stored {stored['columns']}")

    def table(self, name: str) -> DataFrame:
        """Rows of a table; none if it was never written."""
        schema = self.schemas[name]
        if name not in self._tables:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in self._tables[name]["paths"]])

    def write(self, replaced: Mapping[str, DataFrame] | None = None, appended: Mapping[str, DataFrame] | None = None) -> Stored:
        """A version with some tables written anew and rows added to others; the rest stay as they are here."""
        tables = dict(self._tables)
        for rows, more in ((replaced or {}, False), (appended or {}, True)):
            for name, df in rows.items():
                columns = [f.name for f in self.schemas[name].fields]
                if not set(columns) <= set(df.columns) or _fields(df.select(columns).schema) != _fields(self.schemas[name]):
                    raise SchemaMismatch(f"{name}: given {_fields(df.schema)}")
                path = f"{name}/{uuid.uuid4().hex}"
                df.select(columns).write.parquet(f"{self.root}/{path}")
                before = tables.get(name, {}).get("paths", []) if more else []
                tables[name] = {"paths": [*before, path], "columns": [list(f) for f in _fields(self.schemas[name])]}
        if self._commits.get(self.version + 1):
            raise RuntimeError(f"version {self.version + 1} was written by somebody else")
        self._commits.put(self.version + 1, {"tables": tables})
        return Stored(self.spark, self.root, {n: s.simpleString().removeprefix("struct<").removesuffix(">") for n, s in self.schemas.items()}, self.version + 1)
