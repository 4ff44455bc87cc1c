"""Queries over change logs: the latest row per key, current state, merge with deletes, unions and totals."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from formwright.plans.spec import Column as Declared
from formwright.sources.files import Files

# The fields that a change-capture connector adds to a flat record, as columns of a change log.
ENVELOPE = (Declared("op", "string", "__op"), Declared("deleted", "string", "__deleted"), Declared("cdc_ts", "timestamp", "__source_ts_ms"), Declared("cdc_lsn", "int64", "__lsn"))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order's columns, one after the other. A partial aggregate, not a window: a key
    with a third of all rows is cut down before anything moves."""
    rest = [c for c in df.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(top).select(*keys, "_row.*").select(*df.columns)


def latest_by_rank(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The same by row_number, for orders that a maximum cannot express."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def current_state(log: DataFrame, keys: list[str], order: list[str], deleted: Column) -> DataFrame:
    """Latest row per key, without keys whose latest row is a deletion."""
    return latest(log, keys, order).where(~F.coalesce(deleted, F.lit(False)))


def merge_changes(target: DataFrame, changes: DataFrame, keys: list[str], deleted: str) -> DataFrame:
    """MERGE with a delete arm: matched and deleted rows go, matched ones take the change, others are added unless deleted.
    changes has one row per key."""
    values = [c for c in target.columns if c not in keys]
    c = changes.select(*keys, *(F.col(v).alias(f"_new_{v}") for v in values), F.coalesce(F.col(deleted), F.lit(False)).alias("_gone"), F.lit(True).alias("_changed"))
    both = target.join(c, keys, "full_outer").where(~F.coalesce("_gone", F.lit(False)))
    return both.select(*keys, *(F.when(F.col("_changed"), F.col(f"_new_{v}")).otherwise(F.col(v)).alias(v) for v in values)).select(*target.columns)


def union(shards: list[DataFrame]) -> DataFrame:
    """UNION ALL by name, absent columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)


def increment(df: DataFrame, column: str, last, upper=None) -> tuple[DataFrame, object]:
    """Rows past the last watermark, and the new one, taken first."""
    upper = df.agg(F.max(column)).first()[0] if upper is None else upper
    return df.where((F.col(column) > F.lit(last)) & (F.col(column) <= F.lit(upper))), upper


def current_of(log: DataFrame, keys: list[str]) -> DataFrame:
    """The current state that a log with the columns of ``ENVELOPE`` tells: the last change of each key by time and log number,
    without deleted ones and without those columns."""
    return current_state(log, keys, ["cdc_ts", "cdc_lsn"], F.col("deleted") == "true").drop(*(c.name for c in ENVELOPE))


def pull(df: DataFrame, column: str, state: str, start=None) -> tuple[DataFrame, Callable[[], None]]:
    """Rows past the watermark that the file ``state`` keeps (without one, past start, or all), and what to call once they
    are safe: it moves the file's watermark to the largest value that was there when the pull began. Whole numbers and texts."""
    files = Files(df.sparkSession)
    last = json.loads(files.read(state))["watermark"] if files.exists(state) else start
    upper = df.agg(F.max(column)).first()[0]
    rows = df.where(F.col(column) <= F.lit(upper)) if upper is not None else df.limit(0)
    if last is not None:
        rows = rows.where(F.col(column) > F.lit(last))

    def commit() -> None:
        if upper is not None and (last is None or upper > last):
            files.write(state + ".part", json.dumps({"column": column, "watermark": upper}).encode())
            files.move(state + ".part", state)

    return rows, commit
