"""A ledger of changes to tables: each is applied once, in order, and may not be altered afterwards."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SCHEMA = "number int, name string, checksum string, applied_at timestamp"


@dataclass(frozen=True)
class Change:
    """A numbered change: its text, of which the ledger keeps a checksum, is SQL, or the description of what `apply` does."""

    number: int
    name: str
    text: str
    apply: Callable[[SparkSession], None] | None = None

    @property
    def checksum(self) -> str:
        return hashlib.sha256(self.text.strip().encode()).hexdigest()

    def run(self, spark: SparkSession) -> None:
        if self.apply is not None:
            self.apply(spark)
            return
        for statement in filter(None, (s.strip() for s in self.text.split(";\n"))):
            spark.sql(statement.rstrip(";"))


class AlteredError(ValueError):
    """A change that the ledger has with another checksum, or under a number that no change has."""


def applied(spark: SparkSession, table: str) -> dict[int, tuple[str, str]]:
    """(name, checksum) of the changes in the ledger, by number; a ledger has as many rows as there are changes."""
    if not spark.catalog.tableExists(table):
        return {}
    return {r.number: (r.name, r.checksum) for r in spark.table(table).collect()}


def migrate(spark: SparkSession, changes: list[Change], table: str = "schema_changes") -> list[int]:
    """Applies the changes that the ledger table does not have, by number, and enters each one when it is done; returns their
    numbers. A second run does nothing. Nothing is applied if a change that is in the ledger has been altered or is gone, or if a new one
    has a number under one that has been applied. A change that fails ends the run: those before it stay applied, and it
    runs again next time, so changes have to bear that (CREATE IF NOT EXISTS, swap())."""
    ordered = sorted(changes, key=lambda c: c.number)
    if len({c.number for c in ordered}) < len(ordered):
        raise ValueError("two changes have one number")
    done = applied(spark, table)
    known = {c.number: c for c in ordered}
    for number, (name, checksum) in sorted(done.items()):
        if number not in known or known[number].checksum != checksum:
            raise AlteredError(f"change {number} ({name}) was applied with another text")
    new = [c for c in ordered if c.number not in done]
    if new and done and new[0].number < max(done):
        raise AlteredError(f"change {new[0].number} ({new[0].name}) comes before one that has been applied")
    if not spark.catalog.tableExists(table):
        spark.createDataFrame([], SCHEMA).write.saveAsTable(table)
    for c in new:
        c.run(spark)
        row = spark.createDataFrame([(c.number, c.name, c.checksum)], "number int, name string, checksum string")
        row.withColumn("applied_at", F.current_timestamp()).write.mode("append").saveAsTable(table)
    return [c.number for c in new]
