"""Outgoing records: key and JSON value of every output, written from the field tables of the contracts.

Fields come in declared order.  Instants are ISO text in UTC.  A field that may be null is written as null, one that may only be absent is left
out, so what is written conforms to its contract whenever the row does.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.ids import iso_instant
from ledgerlens.sources.contracts import CONTRACTS, INSTANT_FIELDS, Field, struct_type

# Contract of every output, and the column that is its key.
OUTPUTS: Mapping[str, tuple[str, str]] = {
    "assessment": ("assessment", "transactionId"),
    "alert": ("alert", "alertId"),
    "notification_request": ("notification_request", "notificationRequestId"),
    "notification_result": ("notification_result", "notificationRequestId"),
    "invalid": ("invalid_ref", "key"),
    "quarantine": ("quarantine_ref", "key"),
}


def _instant_source(name: str, columns: set[str]) -> str:
    """Tables keep an instant as a timestamp or as microseconds, under its name or as <what>_us."""
    return name if name in columns else f"{name.removesuffix('At')}_us"


def _value(df: DataFrame, field: Field) -> Column:
    if field.name not in INSTANT_FIELDS:
        return F.col(field.name)
    source = _instant_source(field.name, set(df.columns))
    micros = F.unix_micros(source) if isinstance(df.schema[source].dataType, T.TimestampType) else F.col(source)
    return iso_instant(micros)


def record_text(contract: str, df: DataFrame) -> Column:
    """JSON text of the rows of ``df``."""
    fields = CONTRACTS[contract]
    values = {f.name: _value(df, f) for f in fields}
    absent = [f.name for f in fields if not f.required and not f.nullable]

    def text(without: set[str]) -> Column:
        return F.to_json(F.struct(*[values[f.name].alias(f.name) for f in fields if f.name not in without]), {"ignoreNullFields": "false"})

    out = text(set())
    for missing in product((False, True), repeat=len(absent)):
        without = {n for n, gone in zip(absent, missing) if gone}
        if without:
            case = [F.col(n).isNull() if n in without else F.col(n).isNotNull() for n in absent]
            out = F.when(F.array_min(F.array(*case)), text(without)).otherwise(out)
    return out


def to_records(output: str, df: DataFrame) -> DataFrame:
    """(key, value) of an output table."""
    contract, key = OUTPUTS[output]
    return df.select(F.col(key).alias("key"), record_text(contract, df).alias("value"))


def from_records(output: str, records: DataFrame) -> DataFrame:
    """``records`` with the typed fields of its contract in place of ``value``."""
    kind = struct_type(OUTPUTS[output][0])
    others = [c for c in records.columns if c != "value"]
    return records.select(*others, F.from_json(F.col("value").cast("string"), kind).alias("r")).select(*others, "r.*")


def write_records(outputs: Mapping[str, DataFrame], root: str, batch_id: int) -> None:
    """Every output as records under its batch number; a repeated batch replaces itself."""
    for name, df in outputs.items():
        to_records(name, df).write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch_id}")


def publish(records: DataFrame, servers: str, topic: str) -> None:
    """Send records to a topic (needs the Kafka connector jar); at least once, readers drop repeats by key."""
    records.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
