"""How a checked query is registered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...sources.tables import read_table as table

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Run
    sql: str | None


CATALOG: dict[str, Entry] = {}


def checked(sql: str | None = None, name: str | None = None):
    """Register a query, by default under its function name, with the SQL that must agree with it."""

    def keep(run: Run) -> Run:
        CATALOG[name or run.__name__] = Entry(run, sql)
        return run

    return keep


def envelopes(events: DataFrame, value) -> DataFrame:
    """Events as messages: type is the topic, user modulo 4 the partition, id the offset."""
    return events.select(
        F.col("event_type").alias("topic"),
        (F.col("user_id") % 4).cast("int").alias("partition"),
        F.col("user_id").cast("string").cast("binary").alias("key"),
        value.cast("binary").alias("value"),
        F.col("event_id").alias("offset"),
    )


def zoneless(name: str, alias: str | None = None):
    return F.col(name).cast("timestamp_ntz").alias(alias or name.split(".")[-1])


def cents(name: str):
    """Money as an exact decimal, so that sums do not depend on their order."""
    return F.col(name).cast("decimal(18,2)")


def number(column):
    return column.cast("double")


__all__ = ["CATALOG", "DataFrame", "F", "SparkSession", "cents", "checked", "envelopes", "number", "table", "zoneless"]
