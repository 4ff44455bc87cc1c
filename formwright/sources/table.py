"""Iceberg v2 tables without a catalog: rows by Spark, metadata by the driver.

A commit writes data files, delete files, manifests, the manifest list, v{N}.metadata.json and, last, version-hint.text, which
makes it visible. One writer at a time; a version that exists already is refused.
"""

from __future__ import annotations

import datetime
import json
import struct
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from formwright.errors import SchemaError, SinkError, SourceError
from formwright.operators import partition as P
from formwright.sources import avro
from formwright.sources.files import Files

# Type names of the format, and the reserved ids of delete files.
NAMES = {"boolean": "boolean", "bigint": "long", "double": "double", "string": "string", "date": "date", "timestamp_ntz": "timestamp"}
SPARK = {v: k for k, v in NAMES.items()}
PATH_ID, POS_ID = 2147483546, 2147483545
#: Places of deleted rows that a task writes, about.
DELETES_PER_TASK = 500_000
KEYS = ("boolean", "long", "timestamp", "date", "string")
_AVRO = {"boolean": "boolean", "int": "int", "long": "long", "double": "double", "string": "string", "date": {"type": "int", "logicalType": "date"}, "timestamp": {"type": "long", "logicalType": "timestamp-micros", "adjust-to-utc": False}}


def local(path: Column) -> Column:
    """A file's address as manifests have it: local ones without a scheme."""
    return F.regexp_replace(path, "^file:/+", "/")


@dataclass
class DataFile:
    path: str
    records: int
    size: int
    partition: dict
    stats: dict = field(default_factory=dict)
    content: int = 0
    sequence: int | None = None
    snapshot: int | None = None


@dataclass
class MergeSummary:
    distinct_keys: int = 0
    keys_updated: int = 0
    keys_inserted: int = 0
    prior_rows_replaced: int = 0
    duplicates_in_input: int = 0
    null_key_rows: int = 0
    data_files_scanned: int = 0
    data_files_pruned: int = 0
    delete_files: int = 0
    position_deletes: int = 0


@dataclass
class Summary:
    rows: int
    bytes: int
    files: int
    metadata: str
    snapshot_id: int
    merge: MergeSummary | None = None


def fields_of(schema: T.StructType) -> list[dict]:
    out = []
    for i, f in enumerate(schema.fields, 1):
        kind = f.dataType.simpleString()
        if kind not in NAMES:
            raise SchemaError(f"column `{f.name}`: type {kind} has no place in a table")
        out.append({"id": i, "name": f.name, "required": not f.nullable, "type": NAMES[kind]})
    return out


def evolved(old: list[dict], new: list[dict], last_id: int) -> tuple[list[dict], int]:
    """The table's fields after a write of new ones: by name, optional additions alone."""
    by_name, out = {f["name"]: f for f in new}, []
    for f in old:
        n = by_name.pop(f["name"], None)
        if n is None:
            raise SchemaError(f"column `{f['name']}` is not written: dropping or renaming columns is not supported")
        if n["type"] != f["type"]:
            raise SchemaError(f"column `{f['name']}` changed type from {f['type']} to {n['type']}")
        if n["required"] != f["required"]:
            raise SchemaError(f"column `{f['name']}` changed whether it is required")
        out.append(f)
    for n in by_name.values():
        if n["required"]:
            raise SchemaError(f"new column `{n['name']}` must be optional")
        last_id += 1
        out.append(n | {"id": last_id})
    return out, last_id


def _bytes(kind: str, x) -> bytes | None:
    if x is None:
        return None
    if kind == "boolean":
        return b"\x01" if x else b"\x00"
    if kind == "string":
        return x.encode()
    if kind == "double":
        return struct.pack("<d", x)
    return struct.pack("<i" if kind in ("int", "date") else "<q", _plain(kind, x))


def _plain(kind: str, x):
    """Dates as days, timestamps as microseconds."""
    if x is None or kind not in ("date", "timestamp"):
        return x
    if kind == "date":
        return (x - datetime.date(1970, 1, 1)).days if isinstance(x, datetime.date) else x
    return (x - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1) if isinstance(x, datetime.datetime) else x


def _value(kind: str, data: bytes):
    if kind == "boolean":
        return data == b"\x01"
    if kind == "string":
        return data.decode()
    if kind == "double":
        return struct.unpack("<d", data)[0]
    n = struct.unpack("<i" if kind in ("int", "date") else "<q", data)[0]
    if kind == "date":
        return datetime.date(1970, 1, 1) + datetime.timedelta(days=n)
    return datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=n) if kind == "timestamp" else n


def _map(id_: int, value: str, key_id: int) -> dict:
    return {"type": "array", "logicalType": "map", "items": {"type": "record", "name": f"k{key_id}_v{key_id + 1}", "fields": [{"name": "key", "type": "int", "field-id": key_id}, {"name": "value", "type": value, "field-id": key_id + 1}]}}


def _manifest_schema(parts: list[P.Field]) -> dict:
    opt = lambda t: ["null", t]
    f = lambda name, kind, id_: {"name": name, "type": kind, "field-id": id_} | ({"default": None} if isinstance(kind, list) else {})
    tuple_ = {"type": "record", "name": "r102", "fields": [f(p.name, opt(_AVRO[p.result]), p.id) for p in parts]}
    file = [f("content", "int", 134), f("file_path", "string", 100), f("file_format", "string", 101), f("partition", tuple_, 102), f("record_count", "long", 103), f("file_size_in_bytes", "long", 104), f("value_counts", opt(_map(109, "long", 119)), 109), f("null_value_counts", opt(_map(110, "long", 121)), 110), f("lower_bounds", opt(_map(125, "bytes", 126)), 125), f("upper_bounds", opt(_map(128, "bytes", 129)), 128)]
    return {"type": "record", "name": "manifest_entry", "fields": [f("status", "int", 0), f("snapshot_id", opt("long"), 1), f("sequence_number", opt("long"), 3), f("file_sequence_number", opt("long"), 4), f("data_file", {"type": "record", "name": "r2", "fields": file}, 2)]}


_LIST = {"type": "record", "name": "manifest_file", "fields": [{"name": n, "type": t, "field-id": i} for n, t, i in (("manifest_path", "string", 500), ("manifest_length", "long", 501), ("partition_spec_id", "int", 502), ("content", "int", 517), ("sequence_number", "long", 515), ("min_sequence_number", "long", 516), ("added_snapshot_id", "long", 503), ("added_files_count", "int", 504), ("existing_files_count", "int", 505), ("deleted_files_count", "int", 506), ("added_rows_count", "long", 512), ("existing_rows_count", "long", 513), ("deleted_rows_count", "long", 514))]}


class Table:
    """A table's folder, at its current version or none yet."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.files = spark, Files(spark)
        self.path = self.files.full(path).rstrip("/")
        hint = f"{self.path}/metadata/version-hint.text"
        self.version, self.meta = 0, None
        if self.files.exists(hint):
            self.version = int(self.files.read(hint))
            self.meta = json.loads(self.files.read(f"{self.path}/metadata/v{self.version}.metadata.json"))

    # reading

    def anchored(self, path: str) -> str:
        """A recorded address, under the folder where the table is now."""
        old = (self.meta or {}).get("location", self.path).rstrip("/")
        return self.path + path[len(old) :] if path.startswith(old + "/") else path

    @property
    def fields(self) -> list[dict]:
        return next(s["fields"] for s in self.meta["schemas"] if s["schema-id"] == self.meta["current-schema-id"])

    @property
    def partition(self) -> list[P.Field]:
        spec = next(s["fields"] for s in self.meta["partition-specs"] if s["spec-id"] == self.meta["default-spec-id"])
        by_id = {f["id"]: f for f in self.fields}
        out = []
        for s in spec:
            kind, _, n = s["transform"].partition("[")
            source = by_id[s["source-id"]]
            out.append(P.Field(s["field-id"], s["name"], s["source-id"], source["type"], P.Transform(kind, source["name"], int(n[:-1]) if n else None)))
        return out

    def snapshot(self, snapshot_id: int | None = None) -> dict | None:
        if not self.meta:
            raise SourceError(f"no table at {self.path}")
        wanted = self.meta["current-snapshot-id"] if snapshot_id is None else snapshot_id
        got = next((s for s in self.meta["snapshots"] if s["snapshot-id"] == wanted), None)
        if got is None and snapshot_id is not None:
            raise SourceError(f"no snapshot {snapshot_id}")
        return got

    def manifests(self, snapshot_id: int | None = None) -> list[dict]:
        s = self.snapshot(snapshot_id)
        return avro.read(self.files.read(self.anchored(s["manifest-list"])))[0] if s else []

    def live(self, snapshot_id: int | None = None, types: dict | None = None) -> tuple[list[DataFile], list[DataFile]]:
        """Data files and position-delete files of a snapshot."""
        types = types or {f["id"]: f["type"] for f in self.fields}
        out: tuple[list, list] = ([], [])
        for m in self.manifests(snapshot_id):
            for e in avro.read(self.files.read(self.anchored(m["manifest_path"])))[0]:
                d = e["data_file"]
                if e["status"] == 2:
                    continue
                if d["content"] == 2:
                    raise SourceError("the table has equality deletes, which are not supported")
                maps = {n: {x["key"]: x["value"] for x in d[n] or ()} for n in ("value_counts", "null_value_counts", "lower_bounds", "upper_bounds")}
                bound = lambda n, maps=maps: {k: _value(types[k], v) for k, v in maps[n].items() if k in types}
                stats = {"value_counts": maps["value_counts"], "null_value_counts": maps["null_value_counts"], "lower": bound("lower_bounds") if d["content"] == 0 else {}, "upper": bound("upper_bounds") if d["content"] == 0 else {}}
                out[d["content"]].append(DataFile(self.anchored(d["file_path"]), d["record_count"], d["file_size_in_bytes"], d["partition"], stats, d["content"], e["sequence_number"], e["snapshot_id"]))
        return out

    def data_files(self) -> list[DataFile]:
        """Files whose rows are the table; refused where deletes hide some of them."""
        data, deletes = self.live()
        if deletes:
            raise SourceError("delete files hide some rows of this table, and a list of its data files would show them again")
        total = int(self.snapshot()["summary"]["total-records"]) if self.snapshot() else 0
        if sum(d.records for d in data) != total:
            raise SourceError("the data files do not add up to the snapshot's total")
        return data

    def read_schema(self, snapshot_id: int | None = None) -> T.StructType:
        fields = self.fields
        if snapshot_id is not None:
            sid = self.snapshot(snapshot_id).get("schema-id", self.meta["current-schema-id"])
            fields = next(s["fields"] for s in self.meta["schemas"] if s["schema-id"] == sid)
        return T.StructType([T.StructField(f["name"], T._parse_datatype_string(SPARK[f["type"]])) for f in fields])

    def _positions(self, deletes: list[DataFile]) -> DataFrame:
        return self.spark.read.schema("file_path string, pos long").parquet(*(d.path for d in deletes)).select(F.col("file_path").alias("_f"), F.col("pos").alias("_p"))

    def _rows(self, data: list[DataFile], deletes: list[DataFile], schema: T.StructType) -> DataFrame:
        """Live rows with their place, _f and _p. The anti-join is left out where nothing is deleted."""
        df = self.spark.read.schema(schema).parquet(*(d.path for d in data)).select(*(F.col(f"`{n}`") for n in schema.names), local(F.col("_metadata.file_path")).alias("_f"), F.col("_metadata.row_index").alias("_p"))
        return df.join(self._positions(deletes), ["_f", "_p"], "left_anti") if deletes else df

    def scan(self, snapshot_id: int | None = None, prune: dict[str, tuple] | None = None) -> DataFrame:
        """The rows of the current or a given snapshot; columns added later read as null in older files. prune: ranges
        {column: (low, high)} of which files that hold none are not read; the caller still filters."""
        schema = self.read_schema(snapshot_id)
        data, deletes = self.live(snapshot_id) if self.snapshot(snapshot_id) else ([], [])
        if prune:
            data = self.pruned(data, {n: lh for n, lh in prune.items()})[0]
        if not data:
            return self.spark.createDataFrame([], schema)
        touched = [d for d in deletes if d.records]
        if not touched:
            return self.spark.read.schema(schema).parquet(*(d.path for d in data))
        return self._rows(data, touched, schema).drop("_f", "_p")

    def pruned(self, data: list[DataFile], ranges: dict[str, tuple]) -> tuple[list[DataFile], int]:
        """Files that may hold a row within all ranges, and how many were left out. Without bounds a file stays."""
        ids = {f["name"]: f["id"] for f in self.fields}
        kept = [d for d in data if all(ids[n] not in d.stats["lower"] or ids[n] not in d.stats["upper"] or not (d.stats["upper"][ids[n]] < low or d.stats["lower"][ids[n]] > high) for n, (low, high) in ranges.items() if n in ids and low is not None)]
        return kept, len(data) - len(kept)

    def inspect(self) -> dict:
        s = self.snapshot()
        totals = {k: int(s["summary"].get(k, 0)) for k in ("total-records", "total-data-files", "total-delete-files", "total-position-deletes")} if s else {}
        return {"format-version": self.meta["format-version"], "table-uuid": self.meta["table-uuid"], "snapshot-id": s["snapshot-id"] if s else None, **totals, "live-records": totals.get("total-records", 0) - totals.get("total-position-deletes", 0), "fields": self.fields, "version": self.version}

    # writing

    def write(self, rows: DataFrame, mode: str = "create", partition_by: tuple[str, ...] = (), merge_on: tuple[str, ...] = (), codec: str = "snappy", schema: T.StructType | None = None, properties: dict[str, str] | None = None, before: Callable[[], None] = lambda: None) -> Summary:
        """Commit rows. mode: create (any earlier version is no parent), append or merge. A column __seq, if there,
        orders the rows (last wins in a merge) and is not stored. All checks come before the first file. before: runs once
        the rows are written and nothing is committed yet; if it raises, their files go."""
        order = "__seq" in rows.columns
        # without a schema every column is optional: whether a plan may give nulls is no promise of its author
        schema = schema or T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields if f.name != "__seq"])
        prior = self.meta if mode != "create" else None
        new = fields_of(schema)
        if prior:
            fields, last_id = evolved(self.fields, new, prior["last-column-id"])
            parts = self.partition
            wanted = P.resolve(partition_by, fields)
            if [(p.name, p.source_id, p.transform.text) for p in wanted] != [(p.name, p.source_id, p.transform.text) for p in parts]:
                raise SchemaError("partition_by differs from the table's partition spec")
        else:
            fields, last_id = new, len(new)
            parts = P.resolve(partition_by, fields)
        keys = tuple(merge_on)
        if mode == "merge":
            by_name = {f["name"]: f for f in fields}
            if not keys:
                raise SchemaError("a merge needs at least one key: no key column given")
            for k in keys:
                if k not in by_name:
                    raise SchemaError(f"merge key `{k}` is not in the schema")
                if keys.count(k) > 1:
                    raise SchemaError(f"merge key `{k}` is named twice")
                if by_name[k]["type"] not in KEYS:
                    raise SchemaError(f"merge key `{k}`: {by_name[k]['type']} cannot be a key")
        if mode != "create" and self.files.exists(f"{self.path}/metadata/v{self.version + 1}.metadata.json"):
            raise SinkError(f"version {self.version + 1} exists already: another writer was here")

        names = [f["name"] for f in fields if f["name"] in schema.names]
        tagged = rows.select(*(F.col(f"`{n}`") for n in names), *([F.col("__seq")] if order else []))
        whole = reduce(lambda a, b: a & b, (F.col(f"`{k}`").isNotNull() for k in keys)) if keys else F.lit(False)
        if mode == "merge":
            w = Window.partitionBy(*(F.col(f"`{k}`") for k in keys)).orderBy(F.col("__seq").desc() if order else F.monotonically_increasing_id().desc())
            # rows without a key are kept apart from the window: they may be many, and none supersedes another
            keyed = tagged.where(whole).withColumn("__last", F.row_number().over(w) == 1)
            tagged = keyed.unionByName(tagged.where(~whole).withColumn("__last", F.lit(True)))
        else:
            tagged = tagged.withColumn("__last", F.lit(True))
        added = self._write_data(tagged, fields, parts, codec, order, before, mode == "merge")
        superseded = [d for d in added if d.stats.pop("superseded")]
        if not added and parts and mode != "merge":
            raise SinkError("a partitioned write of no rows")

        summary = None
        removed: list[DataFile] = []
        if mode == "merge":
            summary, removed = self._merge(added, keys, whole, fields, parts, superseded, codec, prior)
        meta_path, snapshot = self._commit(prior, fields, last_id, parts, added, removed, mode, properties or {})
        return Summary(sum(d.records for d in added), sum(d.size for d in added), len(added), meta_path, snapshot, summary)

    def add_files(self, paths: list[str], partition_by: tuple[str, ...] = ()) -> Summary:
        """Commit Parquet files that exist already, where they are, in one snapshot: those of writers that worked side by side.
        Their columns must be the table's, by name and type, and each file's rows of one partition."""
        if not paths:
            raise SinkError("no files to add")
        paths = [self.files.full(p) for p in paths]
        prior = self.meta
        known = {f.path for f in self.live()[0]} if prior and self.snapshot() else set()
        if again := known.intersection(paths):
            raise SinkError(f"{sorted(again)[0]} is in the table already")
        new = fields_of(T.StructType([T.StructField(f.name, f.dataType) for f in self.spark.read.option("mergeSchema", "true").parquet(*paths).schema.fields]))
        fields, last_id = evolved(self.fields, new, prior["last-column-id"]) if prior else (new, len(new))
        parts = self.partition if prior else P.resolve(partition_by, fields)
        stats = self._stats(paths, fields, [f["name"] for f in fields], parts)
        if parts:
            values = F.struct(*(P.expression(p, F.col(f"`{p.transform.source}`")).alias(p.name) for p in parts))
            rows = self.spark.read.parquet(*paths).select(local(F.col("_metadata.file_path")).alias("f"), values.alias("v"))
            several = rows.groupBy("f").agg((~F.min("v").eqNullSafe(F.max("v"))).alias("mixed")).where("mixed").first()
            if several:
                raise SchemaError(f"{several.f} holds rows of several partitions")
        empty = {"records": 0, "partition": {}, "value_counts": {}, "null_value_counts": {}, "lower": {}, "upper": {}}
        added = []
        for p in paths:
            s = stats.get(p, empty)
            added.append(DataFile(p, s["records"], self.files.size(p), {x.name: _plain(x.result, s["partition"].get(x.name)) for x in parts}, {k: s[k] for k in ("value_counts", "null_value_counts", "lower", "upper")}))
        meta_path, snapshot = self._commit(prior, fields, last_id, parts, added, [], "append", {})
        return Summary(sum(d.records for d in added), sum(d.size for d in added), len(added), meta_path, snapshot)

    def _write_data(self, df: DataFrame, fields: list[dict], parts: list[P.Field], codec: str, order: bool, before: Callable[[], None], merge: bool) -> list[DataFile]:
        by_name = {f["name"]: f for f in fields}
        columns = [c for c in df.columns if not c.startswith("__")]
        staging = f"{self.path}/data/.staging-{uuid.uuid4().hex}"
        out = df.select(*(F.col(f"`{c}`").alias(c, metadata={"parquet.field.id": by_name[c]["id"]}) for c in columns), F.col("__last"), *([F.col("__seq")] if order else []), *(P.expression(p, F.col(f"`{p.transform.source}`")).alias(f"__p{i}") for i, p in enumerate(parts)))
        folders = [f"__p{i}" for i in range(len(parts))]
        if parts:  # a tuple's rows meet in one task, or in several where they are many: adaptive execution may split a rebalance
            out = out.hint("rebalance", *map(F.col, folders))
        if order:
            out = out.sortWithinPartitions("__last", *folders, "__seq").drop("__seq")
        elif parts:
            out = out.sortWithinPartitions("__last", *folders)
        # a writer sorts its rows by the folders that they go to: without parts or a merge there is one, and no sort
        folders = ["__last", *folders] if parts or merge else []
        writer = out.select(*(F.col(f"`{c}`") for c in columns), *(F.col(p).cast("string").alias(p) for p in folders)).write.option("compression", codec)
        try:
            (writer.partitionBy(*folders) if folders else writer).parquet(staging)
            before()
        except BaseException:
            self.files.remove(staging)
            raise
        got = self.files.walk(staging, ".parquet")
        if not got:
            if not parts:
                self.spark.createDataFrame([], self._typed(fields)).coalesce(1).write.option("compression", codec).mode("overwrite").parquet(staging)
                got = self.files.walk(staging, ".parquet")
        stats = self._stats(got, fields, [c for c in columns], parts) if got else {}

        def placed(source: str) -> DataFile:
            s = stats.get(source, {"records": 0, "partition": {}, "value_counts": {}, "null_value_counts": {}, "lower": {}, "upper": {}})
            folder = "/".join(f"{p.name}={P.path_text(p, _plain(p.result, s['partition'].get(p.name)) if p.result == 'int' else s['partition'].get(p.name))}" for p in parts)
            target = f"{self.path}/data/{folder + '/' if folder else ''}{uuid.uuid4().hex}.parquet"
            self.files.move(source, target)
            return DataFile(target, s["records"], self.files.size(target), {p.name: _plain(p.result, s["partition"].get(p.name)) for p in parts}, {k: s[k] for k in ("value_counts", "null_value_counts", "lower", "upper")} | {"superseded": "__last=false" in source})

        with ThreadPoolExecutor(16) as pool:  # a store may take its time for each
            added = list(pool.map(placed, got))
        self.files.remove(staging)
        return added

    def _typed(self, fields: list[dict]) -> T.StructType:
        return T.StructType([T.StructField(f["name"], T._parse_datatype_string(SPARK[f["type"]]), True, {"parquet.field.id": f["id"]}) for f in fields])

    def _bounds(self, paths: list[str], fields: list[dict], columns: list[str], parts: list[P.Field]) -> DataFrame:
        own = [f for f in fields if f["name"] in columns]
        df = self.spark.read.schema(T.StructType([T.StructField(x.name, x.dataType) for x in self._typed(fields).fields if x.name in columns])).parquet(*paths)
        aggs = [F.count("*").alias("n")]
        for f in own:
            c = F.col(f"`{f['name']}`")
            real = F.when(~F.isnan(c), c) if f["type"] == "double" else c
            aggs += [F.count(c).alias(f"c{f['id']}"), F.min(real).alias(f"l{f['id']}"), F.max(real).alias(f"u{f['id']}")]
        aggs += [F.first(P.expression(p, F.col(f"`{p.transform.source}`"))).alias(f"p{i}") for i, p in enumerate(parts)]
        # bounds of text alone would have each task sort all of its rows by file; beside a set, an empty one, they are hashed
        aggs += [F.collect_set(F.lit(None).cast("int")).alias("hashed")]
        return df.groupBy(local(F.col("_metadata.file_path")).alias("f")).agg(*aggs)

    def _stats(self, paths: list[str], fields: list[dict], columns: list[str], parts: list[P.Field]) -> dict[str, dict]:
        """Counts and exact bounds per file, from one aggregate over the files just written; NaN is no bound."""
        own, out = [f for f in fields if f["name"] in columns], {}
        for r in self._bounds(paths, fields, columns, parts).collect():
            out[r.f] = {
                "records": r.n,
                "partition": {p.name: r[f"p{i}"] for i, p in enumerate(parts)},
                "value_counts": {f["id"]: r.n for f in own},
                "null_value_counts": {f["id"]: r.n - r[f"c{f['id']}"] for f in own},
                "lower": {f["id"]: r[f"l{f['id']}"] for f in own if r[f"l{f['id']}"] is not None},
                "upper": {f["id"]: r[f"u{f['id']}"] for f in own if r[f"u{f['id']}"] is not None},
            }
        return out

    def _merge(self, added: list[DataFile], keys, whole, fields, parts, superseded, codec, prior) -> tuple[MergeSummary, list[DataFile]]:
        quoted = [F.col(f"`{k}`") for k in keys]
        # the rows' keys come from the files just written: to make the rows again may cost far more
        kinds = T.StructType([f for f in self._typed(fields).fields if f.name in keys])
        rows = self.spark.read.schema(kinds).parquet(*(d.path for d in added)) if added else self.spark.createDataFrame([], kinds)
        head = rows.agg(F.count(F.when(whole, 1)).alias("keyed"), F.count(F.when(~whole, 1)).alias("nulls"), *(x for i, k in enumerate(quoted) for x in (F.min(F.when(whole, k)).alias(f"l{i}"), F.max(F.when(whole, k)).alias(f"u{i}")))).first()
        out = MergeSummary(null_key_rows=head.nulls)
        delta = rows.where(whole).select(*quoted).distinct()
        data, deletes = self.live() if prior and self.snapshot() else ([], [])
        gone = [self._whole(d) for d in superseded]
        out.duplicates_in_input = sum(d.records for d in superseded)
        out.distinct_keys = head.keyed - out.duplicates_in_input
        if head.keyed and data:
            scanned, out.data_files_pruned = self.pruned(data, {k: (head[f"l{i}"], head[f"u{i}"]) for i, k in enumerate(keys)})
            ids = {f["name"]: f["id"] for f in self.fields}
            scanned = [d for d in scanned if all(k in ids for k in keys)]
            out.data_files_scanned = len(scanned)
            if scanned:
                live = self._rows(scanned, deletes, T.StructType([f for f in self.read_schema() if f.name in keys]))
                hits = live.join(delta, list(keys), "left_semi").select(*quoted, "_f", "_p")
                gone.append(hits.select("_f", "_p"))
                counts = hits.agg(F.count("*").alias("n"), F.countDistinct(F.struct(*quoted)).alias("k")).first()
                out.prior_rows_replaced, out.keys_updated = counts.n, counts.k
        out.keys_inserted = out.distinct_keys - out.keys_updated
        removed: list[DataFile] = []
        if gone and (out.prior_rows_replaced or out.duplicates_in_input):
            removed = self._write_deletes(reduce(DataFrame.unionAll, gone), out.prior_rows_replaced + out.duplicates_in_input, [*data, *superseded], parts, codec)
        out.delete_files, out.position_deletes = len(removed), sum(d.records for d in removed)
        return out, removed

    def _whole(self, d: DataFile) -> DataFrame:
        return self.spark.range(d.records).select(F.lit(d.path).alias("_f"), F.col("id").alias("_p"))

    def _write_deletes(self, places: DataFrame, number_of: int, data: list[DataFile], parts: list[P.Field], codec: str) -> list[DataFile]:
        """One file per partition that loses rows, in the folder of the rows' own partition, ordered by file and place; several
        where there are many. number_of: how many places there are."""
        tuples = sorted({json.dumps(d.partition, sort_keys=True, default=str) for d in data})
        number = {t: i for i, t in enumerate(tuples)}
        by = {number[json.dumps(d.partition, sort_keys=True, default=str)]: d for d in data}
        table = self.spark.createDataFrame([(d.path, number[json.dumps(d.partition, sort_keys=True, default=str)]) for d in data], "_f string, __t int")
        staging = f"{self.path}/data/.staging-{uuid.uuid4().hex}"
        meta = lambda n: {"parquet.field.id": n}
        # blocks of a file's rows are dealt out, so that a task sorts a bounded number however many go; no place comes twice
        tasks = -(-number_of // DELETES_PER_TASK)
        rows = places.join(F.broadcast(table), "_f").repartition(tasks, "__t", "_f", F.floor(F.col("_p") / DELETES_PER_TASK)).sortWithinPartitions("__t", "_f", "_p")
        rows.select(F.col("_f").alias("file_path", metadata=meta(PATH_ID)), F.col("_p").alias("pos", metadata=meta(POS_ID)), "__t").write.option("compression", codec).partitionBy("__t").parquet(staging)
        paths = self.files.walk(staging, ".parquet")
        counts = dict(self.spark.read.schema("file_path string").parquet(*paths).groupBy(local(F.col("_metadata.file_path")).alias("f")).count().collect()) if paths else {}
        out = []
        for source in paths:
            like = by[int(source.rsplit("__t=", 1)[1].split("/")[0])]
            folder = like.path[len(f"{self.path}/data/") :].rpartition("/")[0]
            target = f"{self.path}/data/{folder + '/' if folder else ''}{uuid.uuid4().hex}-deletes.parquet"
            self.files.move(source, target)
            out.append(DataFile(target, counts[source], self.files.size(target), like.partition, {}, 1))
        self.files.remove(staging)
        return out

    def _commit(self, prior, fields, last_id, parts, added, removed, mode, properties) -> tuple[str, int]:
        now = int(time.time() * 1000)
        snapshot = (uuid.uuid4().int & (1 << 63) - 1) or 1
        sequence = (prior["last-sequence-number"] if prior else 0) + 1
        folder = f"{self.path}/metadata"
        parent = prior["current-snapshot-id"] if prior and prior["snapshots"] else None
        entries = self.manifests() if parent is not None else []
        kinds = {f["id"]: f["type"] for f in fields}
        spec = [{"name": p.name, "transform": p.transform.text, "source-id": p.source_id, "field-id": p.id} for p in parts]
        schema_set = lambda fs: {(f["id"], f["name"], f["type"], f["required"]) for f in fs}
        schemas = list(prior["schemas"]) if prior else []
        schema_id = next((s["schema-id"] for s in schemas if schema_set(s["fields"]) == schema_set(fields)), None)
        if schema_id is None:
            schema_id = len(schemas)
            schemas.append({"type": "struct", "schema-id": schema_id, "fields": fields})
        pairs = lambda m: [{"key": k, "value": v} for k, v in m.items()]
        bounds = lambda m: [{"key": k, "value": _bytes(kinds[k], v)} for k, v in m.items()]
        for content, files in ((0, added), (1, removed)):
            if not files:
                continue
            rows = [{"status": 1, "snapshot_id": snapshot, "sequence_number": sequence, "file_sequence_number": sequence, "data_file": {"content": content, "file_path": d.path, "file_format": "PARQUET", "partition": d.partition, "record_count": d.records, "file_size_in_bytes": d.size, "value_counts": pairs(d.stats.get("value_counts", {})), "null_value_counts": pairs(d.stats.get("null_value_counts", {})), "lower_bounds": bounds(d.stats.get("lower", {})), "upper_bounds": bounds(d.stats.get("upper", {}))}} for d in files]
            data = avro.write(_manifest_schema(parts), rows, {"schema": json.dumps(schemas[schema_id]), "partition-spec": json.dumps(spec), "partition-spec-id": "0", "format-version": "2", "content": "deletes" if content else "data"})
            path = f"{folder}/{uuid.uuid4().hex}-m{content}.avro"
            self.files.write(path, data)
            entries.append({"manifest_path": path, "manifest_length": len(data), "partition_spec_id": 0, "content": content, "sequence_number": sequence, "min_sequence_number": sequence, "added_snapshot_id": snapshot, "added_files_count": len(files), "existing_files_count": 0, "deleted_files_count": 0, "added_rows_count": sum(d.records for d in files), "existing_rows_count": 0, "deleted_rows_count": 0})
        list_path = f"{folder}/snap-{snapshot}-{uuid.uuid4().hex}.avro"
        self.files.write(list_path, avro.write(_LIST, entries))
        of = lambda content, key: sum(e[key] for e in entries if e["content"] == content)
        deleted = sum(d.records for d in removed)
        summary = {"operation": "overwrite" if deleted else "append", "added-data-files": str(len(added)), "added-records": str(sum(d.records for d in added)), "total-records": str(of(0, "added_rows_count")), "total-data-files": str(of(0, "added_files_count")), "total-delete-files": str(of(1, "added_files_count")), "total-position-deletes": str(of(1, "added_rows_count"))}
        if removed:
            summary |= {"added-delete-files": str(len(removed)), "added-position-deletes": str(deleted)}
        one = {"snapshot-id": snapshot, "sequence-number": sequence, "timestamp-ms": now, "summary": summary | properties, "manifest-list": list_path, "schema-id": schema_id} | ({"parent-snapshot-id": parent} if parent is not None else {})
        version = self.version + 1 if prior else 1
        meta = {
            "format-version": 2,
            "table-uuid": prior["table-uuid"] if prior else str(uuid.uuid4()),
            "location": prior["location"] if prior else self.path,
            "last-sequence-number": sequence,
            "last-updated-ms": now,
            "last-column-id": last_id,
            "current-schema-id": schema_id,
            "schemas": schemas,
            "default-spec-id": 0,
            "partition-specs": [{"spec-id": 0, "fields": spec}],
            "last-partition-id": max([999, *(p.id for p in parts)]),
            "default-sort-order-id": 0,
            "sort-orders": [{"order-id": 0, "fields": []}],
            "properties": {},
            "current-snapshot-id": snapshot,
            "refs": {"main": {"snapshot-id": snapshot, "type": "branch"}},
            "snapshots": [*(prior["snapshots"] if prior else []), one],
            "snapshot-log": [*(prior["snapshot-log"] if prior else []), {"timestamp-ms": now, "snapshot-id": snapshot}],
            "metadata-log": [*(prior["metadata-log"] if prior else []), *([{"timestamp-ms": prior["last-updated-ms"], "metadata-file": f"{folder}/v{self.version}.metadata.json"}] if prior else [])],
        }
        path = f"{folder}/v{version}.metadata.json"
        # of two writers that saw the same version, one finds this file made
        if not self.files.write(path, json.dumps(meta, indent=2).encode(), replace=not prior):
            raise SinkError(f"version {version} exists already: another writer was here")
        self.files.write(f"{folder}/version-hint.text", str(version).encode())
        self.version, self.meta = version, meta
        return path, snapshot
