"""Schema inference: flags per path, and the narrowest type that they allow."""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formwright.plans.spec import Column

#: What was seen at a path, one bit each.
BOOL, INT, FLOAT, STRING, DATE, MOMENT, NESTED, OTHER_TEXT = (1 << i for i in range(8))
_DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")
_MOMENT = re.compile(r"([0-9]{4}-[0-9]{2}-[0-9]{2})[Tt]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?([Zz]|[+-]([01][0-9]|2[0-3]):[0-5][0-9])")


def is_date(s: str) -> bool:
    if not _DATE.fullmatch(s):
        return False
    try:
        datetime.date.fromisoformat(s)
    except ValueError:
        return False
    return True


def is_moment(s: str) -> bool:
    m = _MOMENT.fullmatch(s)
    return bool(m) and is_date(m[1])


def flags(value: Any) -> int:
    if value is None:
        return 0
    if isinstance(value, bool):
        return BOOL
    if isinstance(value, int):
        return INT if -(1 << 63) <= value < 1 << 64 else FLOAT
    if isinstance(value, float):
        return FLOAT
    if isinstance(value, str):
        return STRING | (DATE if is_date(value) else MOMENT if is_moment(value) else OTHER_TEXT)
    return NESTED


def decide(seen: int) -> str:
    """Anything nested is json; kinds of scalars that do not go together are string; so is what was always null."""
    if seen & NESTED:
        return "json"
    text, number, truth = bool(seen & STRING), bool(seen & (INT | FLOAT)), bool(seen & BOOL)
    if text + number + truth > 1:
        return "string"
    if text:
        return {DATE: "date", MOMENT: "timestamp"}.get(seen & (DATE | MOMENT | OTHER_TEXT), "string")
    if number:
        return "float64" if seen & FLOAT else "int64"
    return "bool" if truth else "string"


def leaves(value: Any, prefix: str = "") -> Iterator[tuple[str, Any]]:
    """Dotted paths of an object's leaves, keys in order; arrays, scalars and empty objects are leaves."""
    if isinstance(value, dict) and (value or not prefix):
        for k in sorted(value):
            yield from leaves(value[k], f"{prefix}.{k}" if prefix else k)
    elif prefix:
        yield prefix, value


def _observe(flatten: bool):
    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        for batch in batches:
            for seq, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                value = json.loads(raw)
                if not isinstance(value, dict):
                    continue
                pairs = leaves(value) if flatten else ((k, value[k]) for k in sorted(value))
                for at, (path, x) in enumerate(pairs):
                    own = found.setdefault(path, [0, (seq, at)])
                    own[0] |= flags(x)
                    own[1] = min(own[1], (seq, at))
        rows = [{"path": p, "flags": f, "seq": s, "at": a} for p, (f, (s, a)) in found.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("flags", pa.int32()), ("seq", pa.int64()), ("at", pa.int32())]))

    return observe


def observed(good: DataFrame, flatten: bool = True) -> DataFrame:
    """(path, flags, first): one partial row per task and path, then one per path."""
    seen = good.select("seq", "raw").mapInArrow(_observe(flatten), "path string, flags int, seq long, at int")
    return seen.groupBy("path").agg(F.bit_or("flags").alias("flags"), F.min(F.struct("seq", "at")).alias("first"))


def infer_columns(good: DataFrame, flatten: bool = True) -> tuple[Column, ...]:
    """A column per path, in the order of first sight. The result is as long as the schema is wide."""
    rows = observed(good, flatten).collect()
    return tuple(Column(r.path, decide(r.flags)) for r in sorted(rows, key=lambda r: tuple(r.first)))
