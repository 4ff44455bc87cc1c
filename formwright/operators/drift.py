"""Schema drift: paths of a record that no column covers, and values that do not fit their column."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column as Col
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from formwright.functions import jsontext
from formwright.functions.values import get, segments
from formwright.operators.infer import decide, flags, leaves
from formwright.plans.spec import Column

#: Different paths that a report tells of, per kind.
MOST_PATHS = 1_000
EVENT = "array<struct<path:string,seen:int,example:string>>"


def covered(columns: tuple[Column, ...]) -> dict | None:
    """Keys that columns select, nested; None stands for everything below."""
    top: dict[str, Any] = {}
    for c in columns:
        parts = segments(c.path)
        if not parts:
            return None
        at = top
        for p in parts[:-1]:
            at = at.setdefault(p, {})
            if at is None:
                break
        if at is not None:
            at[parts[-1]] = None
    return top


def uncovered(value: Any, tree: dict | None, flatten: bool, prefix: str = "") -> Iterator[tuple[str, Any]]:
    """(path, value) of what no column takes, keys in order; nulls are no events. A value that is not an object where columns
    look for deeper keys is not reported."""
    if tree is None or not isinstance(value, dict):
        return
    for k in sorted(value):
        path = f"{prefix}.{k}" if prefix else k
        if k in tree:
            yield from uncovered(value[k], tree[k], flatten, path)
        elif flatten and isinstance(value[k], dict) and value[k]:
            yield from ((p, x) for p, x in leaves(value[k], path) if x is not None)
        elif value[k] is not None:
            yield path, value[k]


def may_drift(v: Col, tree: dict | None) -> Col:
    """A native test that is true for every record with an event: some object has a key that the tree has not."""

    def nodes(at: dict, path: tuple[str, ...]) -> Iterator[tuple[tuple[str, ...], list[str]]]:
        yield path, list(at)
        for k, below in at.items():
            if below is not None:
                yield from nodes(below, (*path, k))

    out = F.lit(False)
    for path, keys in nodes(tree, ()) if tree is not None else ():
        held = F.map_keys(F.try_variant_get(get(v, path), "$", "map<string,variant>"))
        out = out | F.coalesce(F.size(F.array_except(held, F.array(*map(F.lit, keys)) if keys else F.array().cast("array<string>"))) > 0, F.lit(False))
    return out


def object_keys(tree: dict | None) -> list[tuple[Callable[[Col], Col], Col]] | None:
    """For each object that columns look into: its keys in a record's text, and those that the columns take. None where a key
    cannot be written as a path."""
    out: list[tuple[Callable[[Col], Col], Col]] = []

    def add(at: dict, path: tuple[str, ...]) -> None:
        where = "$" + "".join(f"['{p}']" for p in path)
        out.append((lambda raw: F.json_object_keys(F.get_json_object(raw, where) if path else raw), F.array(*map(F.lit, at))))
        for k, below in at.items():
            if below is not None:
                add(below, (*path, k))

    def plain(at: dict) -> bool:
        return all("'" not in k and "?" not in k and (below is None or plain(below)) for k, below in at.items())

    if tree is not None and not plain(tree):
        return None
    if tree is not None:
        add(tree, ())
    return out


def events(tree: dict | None, flatten: bool):
    """An Arrow function over the raw text of records that may drift; null for all others."""

    @F.pandas_udf(EVENT)
    def found(raw: pd.Series) -> pd.Series:
        def one(r: str | None):
            return None if not isinstance(r, str) else [{"path": p, "seen": flags(x), "example": jsontext.text(x)} for p, x in uncovered(json.loads(r), tree, flatten)]

        return pd.Series([one(r) for r in raw], dtype=object)

    return found


def rescued(tree: dict | None, flatten: bool):
    """The rescue object of a record: what no column takes, and the misfits (name, JSON text) given; null if both are empty."""

    @F.pandas_udf("string")
    def rescue(raw: pd.Series, misfits: pd.Series) -> pd.Series:
        def one(r: str | None, bad) -> str | None:
            if not isinstance(r, str):
                return None
            own = {p: jsontext.text(x) for p, x in uncovered(json.loads(r), tree, flatten)}
            own |= {m["path"]: m["example"] for m in (bad if bad is not None else ())}
            return "{" + ",".join(f"{jsontext.text(k)}:{own[k]}" for k in sorted(own)) + "}" if own else None

        return pd.Series([one(r, b) for r, b in zip(raw, misfits, strict=True)], dtype=object)

    return rescue


@dataclass
class PathReport:
    path: str
    count: int
    first_record: int
    type: str  # suggested for a new field, declared for a misfit
    examples: list[str]


@dataclass
class Report:
    scanned: int = 0
    rows_with_drift: int = 0
    quarantined: int = 0
    rescued: int = 0
    truncated: bool = False
    new_fields: dict[str, PathReport] = field(default_factory=dict)
    type_mismatches: dict[str, PathReport] = field(default_factory=dict)

    def events(self) -> int:
        return sum(x.count for m in (self.new_fields, self.type_mismatches) for x in m.values())

    def is_clean(self) -> bool:
        return not self.new_fields and not self.type_mismatches

    def suggested_columns(self) -> tuple[Column, ...]:
        return tuple(Column(p, x.type) for p, x in self.new_fields.items())

    def as_dict(self) -> dict:
        form = lambda m, kind: {p: {"count": x.count, "first_record": x.first_record, kind: x.type, "examples": x.examples} for p, x in m.items()}
        return {"records_scanned": self.scanned, "rows_with_drift": self.rows_with_drift, "quarantined": self.quarantined, "rescued": self.rescued, "truncated": self.truncated, "new_fields": form(self.new_fields, "suggested_type"), "type_mismatches": form(self.type_mismatches, "declared_type")}


_ROW = pa.schema([("kind", pa.int32()), ("path", pa.string()), ("n", pa.int64()), ("seen", pa.int32()), ("seqs", pa.list_(pa.int64())), ("examples", pa.list_(pa.string()))])


def _count(most_examples: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, str], list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                for kind, name in enumerate(("new", "misfits")):
                    for e in row[name] or ():
                        own = found.setdefault((kind, e["path"]), [0, 0, []])
                        own[0] += 1
                        own[1] |= e["seen"] or 0
                        own[2].append((row["seq"], e["example"]))
                        if len(own[2]) > 4 * most_examples + 4:
                            own[2] = sorted(own[2])[: max(1, most_examples)]
        rows = []
        for (kind, path), (n, seen, first) in found.items():
            first = sorted(first)[: max(1, most_examples)]
            rows.append({"kind": kind, "path": path, "n": n, "seen": seen, "seqs": [s for s, _ in first], "examples": [x for _, x in first]})
        yield pa.RecordBatch.from_pylist(rows, schema=_ROW)

    return count


def path_counts(rows: DataFrame, most_examples: int) -> DataFrame:
    """(kind, path, n, seen, firsts) of rows (seq, new, misfits): one partial row per task and path, each with its first
    examples alone, then one per path."""
    part = rows.where("size(new) > 0 or size(misfits) > 0").select("seq", "new", "misfits").mapInArrow(_count(most_examples), "kind int, path string, n long, seen int, seqs array<long>, examples array<string>")
    firsts = F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("seqs", "examples")))), 1, max(1, most_examples))
    return part.groupBy("kind", "path").agg(F.sum("n").alias("n"), F.bit_or("seen").alias("seen"), firsts.alias("firsts"))


def report(rows: DataFrame, columns: tuple[Column, ...], most_examples: int, number_of=lambda seqs: {s: s for s in seqs}) -> Report:
    """From rows (seq, new, misfits) of all pushed records. number_of turns positions of lines into those of records."""
    out = Report()
    # by first sight, as many as are told of; the driver never holds more. Both kinds come of one pass
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.col("firsts")[0], "path"))
    ranked = path_counts(rows, most_examples).withColumn("rank", rank).where(F.col("rank") <= MOST_PATHS + 1).orderBy("rank").collect()
    by_kind = [[r for r in ranked if r.kind == kind] for kind in (0, 1)]
    out.truncated = any(len(rs) > MOST_PATHS for rs in by_kind)
    by_kind = [rs[:MOST_PATHS] for rs in by_kind]
    names = number_of(sorted({r.firsts[0].seqs for rs in by_kind for r in rs}))
    declared = {c.name: c.type for c in columns}
    for kind, to in ((0, out.new_fields), (1, out.type_mismatches)):
        for r in sorted(by_kind[kind], key=lambda r: r.path):
            to[r.path] = PathReport(r.path, r.n, names[r.firsts[0].seqs], decide(r.seen) if kind == 0 else declared[r.path], [x.examples for x in r.firsts][:most_examples])
    return out
