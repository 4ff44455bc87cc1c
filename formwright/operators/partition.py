"""Partition transforms of tables, as column expressions."""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formwright.errors import SpecError

TEMPORAL = ("year", "month", "day", "hour")
#: Types a transform takes, by table-format name.
ACCEPTS = {
    "identity": ("boolean", "long", "double", "string", "date", "timestamp"),
    "bucket": ("long", "string", "date", "timestamp"),
    "truncate": ("long", "string"),
    "year": ("date", "timestamp"),
    "month": ("date", "timestamp"),
    "day": ("date", "timestamp"),
    "hour": ("timestamp",),
}
_CALL = re.compile(r"\s*([A-Za-z]+)\s*\(([^()]*)\)\s*")


@dataclass(frozen=True)
class Transform:
    kind: str
    source: str
    n: int | None = None

    @property
    def text(self) -> str:
        return f"{self.kind}[{self.n}]" if self.n is not None else self.kind

    @property
    def field(self) -> str:
        suffix = {"identity": "", "bucket": "_bucket", "truncate": "_trunc"}.get(self.kind, f"_{self.kind}")
        return self.source + suffix


@dataclass(frozen=True)
class Field:
    """A resolved partition field of a table."""

    id: int
    name: str
    source_id: int
    source_type: str
    transform: Transform

    @property
    def result(self) -> str:
        kind = self.transform.kind
        return "int" if kind == "bucket" or kind in TEMPORAL else self.source_type


def split_top(text: str) -> list[str]:
    """Entries of a comma list; commas within parentheses belong to an entry."""
    return [p.strip() for p in re.split(r",(?![^(]*\))", text) if p.strip()]


def parse(text: str) -> Transform:
    text = text.strip()
    if "(" not in text and ")" not in text:
        if not text or re.search(r"[\s,]", text):
            raise SpecError(f"partition_by: cannot read `{text}`")
        return Transform("identity", text)
    m = _CALL.fullmatch(text)
    if not m:
        raise SpecError(f"partition_by: cannot read `{text}`")
    kind, args = m[1].lower(), [a.strip() for a in m[2].split(",")]
    if kind in TEMPORAL or kind == "identity":
        if len(args) != 1 or not args[0]:
            raise SpecError(f"partition_by `{text}`: {kind} takes one column")
        return Transform(kind, args[0])
    if kind not in ("bucket", "truncate"):
        raise SpecError(f"partition_by `{text}`: unknown transform `{m[1]}`")
    if len(args) != 2 or not args[1] or not re.fullmatch("[0-9]+", args[0]) or not 1 <= int(args[0]) < 1 << 31:
        raise SpecError(f"partition_by `{text}`: {kind} takes a number from 1 and a column")
    return Transform(kind, args[1], int(args[0]))


def source_of(text: str) -> str:
    return parse(text).source


def resolve(entries: Iterable[str], fields: list[dict]) -> list[Field]:
    """Entries against a table's fields ({id, name, type}): types checked, ids from 1000, names unique."""
    out: list[Field] = []
    by_name = {f["name"]: f for f in fields}
    for entry in (e for text in entries for e in split_top(text)):
        t = parse(entry)
        if t.source not in by_name:
            raise SpecError(f"partition_by `{entry}`: column `{t.source}` is not in the schema")
        f = by_name[t.source]
        if f["type"] not in ACCEPTS[t.kind]:
            raise SpecError(f"partition_by `{entry}`: {t.kind} does not take {f['type']}")
        if t.field in {x.name for x in out}:
            raise SpecError(f"partition_by: field `{t.field}` appears twice")
        out.append(Field(1000 + len(out), t.field, f["id"], f["type"], t))
    return out


def _u32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def _let(x: Column, f) -> Column:
    """f of x, x worked out once however often f uses it."""
    return F.transform(F.array(x), f)[0]


def _times(x: Column, k: int) -> Column:
    """x * k modulo 2^32, in halves of k so that no product leaves 63 bits."""
    low, high = F.lit(k & 0xFFFF).cast("long"), F.lit(k >> 16).cast("long")
    return _let(x, lambda y: _u32(y * low + F.shiftleft((y * high).bitwiseAND(F.lit(0xFFFF).cast("long")), 16)))


def _rotate(x: Column, r: int) -> Column:
    return _let(x, lambda y: _u32(F.shiftleft(y, r).bitwiseOR(F.shiftrightunsigned(y, 32 - r))))


def _fold(x: Column, r: int) -> Column:
    return _let(x, lambda y: y.bitwiseXOR(F.shiftrightunsigned(y, r)))


def murmur3_long(x: Column) -> Column:
    """Murmur3 (32 bits, seed 0) of a long's eight little-endian bytes, as an unsigned long."""
    h = F.lit(0).cast("long")
    for word in (_u32(x), _u32(F.shiftrightunsigned(x, 32))):
        k = _times(_rotate(_times(word, 0xCC9E2D51), 15), 0x1B873593)
        h = _u32(_times(_rotate(h.bitwiseXOR(k), 13), 5) + F.lit(0xE6546B64).cast("long"))
    h = _times(_fold(h.bitwiseXOR(F.lit(8).cast("long")), 16), 0x85EBCA6B)
    return _fold(_times(_fold(h, 13), 0xC2B2AE35), 16)


def murmur3_bytes(data: bytes) -> int:
    mask, h = 0xFFFFFFFF, 0

    def scrambled(k: int) -> int:
        k = k * 0xCC9E2D51 & mask
        return ((k << 15 | k >> 17) & mask) * 0x1B873593 & mask

    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        h ^= scrambled(int.from_bytes(data[i : i + 4], "little"))
        h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    if whole < len(data):
        h ^= scrambled(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return h ^ h >> 16


@F.pandas_udf(T.LongType())
def murmur3_string(s: pd.Series) -> pd.Series:
    return pd.Series([murmur3_bytes(x.encode()) if isinstance(x, str) else None for x in s], dtype="Int64")


def expression(field: Field, column: Column) -> Column:
    """The partition value; null for null."""
    kind, n, source = field.transform.kind, field.transform.n, field.source_type
    if kind == "identity":
        return column
    if kind == "bucket":
        if source == "string":
            h = murmur3_string(column)
        else:
            h = murmur3_long({"long": column, "date": F.unix_date(column).cast("long") if source == "date" else column, "timestamp": F.unix_micros(column.cast("timestamp")) if source == "timestamp" else column}[source])
        return F.pmod(h.bitwiseAND(F.lit(0x7FFFFFFF).cast("long")), F.lit(n)).cast("int")
    if kind == "truncate":
        return column - F.pmod(column, F.lit(n).cast("long")) if source == "long" else F.substring(column, 1, n)
    day = column.cast("date")
    if kind == "year":
        return F.year(day) - 1970
    if kind == "month":
        return (F.year(day) - 1970) * 12 + F.month(day) - 1
    if kind == "day":
        return F.unix_date(day)
    return F.floor(F.unix_micros(column.cast("timestamp")) / F.lit(3_600_000_000)).cast("int")


def path_text(field: Field, value) -> str:
    """A folder's name for a value: dates readable, anything unusual replaced."""
    if value is None:
        return "__NULL__"
    kind = field.transform.kind
    if kind == "year":
        return f"{1970 + value:04d}"
    if kind == "month":
        return f"{1970 + value // 12:04d}-{value % 12 + 1:02d}"
    if kind in ("day", "hour"):
        day = datetime.date(1970, 1, 1) + datetime.timedelta(days=value // 24 if kind == "hour" else value)
        return f"{day.isoformat()}-{value % 24:02d}" if kind == "hour" else day.isoformat()
    if isinstance(value, bool):
        value = str(value).lower()
    elif isinstance(value, datetime.datetime):
        value = value.isoformat()
    return "".join(c if c.isalnum() or c in "-._" else "_" for c in str(value))
