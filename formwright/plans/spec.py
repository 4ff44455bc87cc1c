"""The dataset spec: everything a run is told, as YAML or JSON."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass
from typing import Any

import yaml
from pyspark.sql import types as T

from formwright.errors import SpecError

# The closed sets of names that a spec may use.
TYPES = {
    "bool": T.BooleanType(),
    "int64": T.LongType(),
    "float64": T.DoubleType(),
    "string": T.StringType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
    "json": T.StringType(),
}
TRANSFORMS = ("lowercase", "uppercase", "trim", "json_encode", "to_string", "dollars_to_cents", "abs", "empty_to_null")
FORMATS = ("jsonl", "json-array")
TARGETS = ("parquet", "iceberg")
CODECS = ("snappy", "uncompressed", "zstd")
MODES = ("infer", "strict")
POLICIES = ("ignore", "warn", "rescue", "quarantine", "error")


@dataclass(frozen=True)
class Column:
    name: str
    type: str = "string"
    source: str | None = None
    transform: str | None = None
    required: bool = False

    @property
    def path(self) -> str:
        return self.source if self.source is not None else self.name


@dataclass(frozen=True)
class Input:
    format: str = "jsonl"
    path: str | None = None


@dataclass(frozen=True)
class Output:
    to: str = "parquet"
    path: str | None = None
    compression: str = "snappy"
    append: bool = False
    partition_by: tuple[str, ...] = ()
    merge_on: tuple[str, ...] = ()


@dataclass(frozen=True)
class Drift:
    policy: str = "warn"
    rescue_column: str = "_rescued"
    max_examples: int = 3


@dataclass(frozen=True)
class Spec:
    dataset: str
    input: Input = Input()
    output: Output = Output()
    mode: str = "infer"
    columns: tuple[Column, ...] = ()
    flatten: bool = True
    row_group_rows: int = 50_000
    infer_sample: int = 1_000
    drift: Drift = Drift()

    def replace(self, **changes: Any) -> Spec:
        return dataclasses.replace(self, **changes)

    def checked(self) -> Spec:
        validate(self)
        return self


#: Where a file's keys go; on the right, the attribute.
_LAYOUT = {
    "dataset": ("dataset", str),
    "source": {"format": ("format", FORMATS), "path": ("path", str)},
    "output": {"format": ("to", TARGETS), "path": ("path", str), "compression": ("compression", CODECS), "partition_by": ("partition_by", list), "merge_on": ("merge_on", list)},
    "schema": ("mode", MODES),
    "columns": ("columns", list),
    "options": {"flatten": ("flatten", bool), "row_group_rows": ("row_group_rows", int), "infer_sample": ("infer_sample", int)},
    "drift": {"policy": ("policy", POLICIES), "rescue_column": ("rescue_column", str), "max_examples": ("max_examples", int)},
}
_COLUMN = {"name": ("name", str), "from": ("source", str), "type": ("type", tuple(TYPES)), "transform": ("transform", TRANSFORMS), "required": ("required", bool)}


def _value(value: Any, kind: Any, where: str) -> Any:
    if isinstance(kind, tuple):
        if value not in kind:
            raise SpecError(f"{where}: unknown value {value!r}, expected one of {', '.join(kind)}")
        return value
    if kind is list:
        return tuple(value or ())
    if kind is int and isinstance(value, bool) or not isinstance(value, kind):
        raise SpecError(f"{where}: expected {kind.__name__}, got {value!r}")
    return value


def _known(data: Any, layout: dict, where: str) -> dict:
    if not isinstance(data, dict):
        raise SpecError(f"{where}: expected a mapping")
    for key in data:
        if key not in layout:
            raise SpecError(f"{where}: unknown field `{key}`, expected one of {', '.join(f'`{k}`' for k in layout)}")
    return {layout[k][0]: _value(v, layout[k][1], f"{where}.{k}") for k, v in data.items() if isinstance(layout[k], tuple) and v is not None}


def from_dict(data: dict) -> Spec:
    own = _known(data, _LAYOUT, "spec")
    if "dataset" not in own:
        raise SpecError("spec: missing field `dataset`")
    parts = {k: _known(data.get(k) or {}, _LAYOUT[k], k) for k in ("source", "output", "options", "drift")}
    columns = []
    for i, c in enumerate(own.pop("columns", ())):
        got = _known(c, _COLUMN, f"columns[{i}]")
        for name in ("name", "type"):
            if name not in got:
                raise SpecError(f"columns[{i}]: missing field `{name}`")
        columns.append(Column(**got))
    return Spec(**own, **parts["options"], columns=tuple(columns), input=Input(**parts["source"]), output=Output(**parts["output"]), drift=Drift(**parts["drift"]))


def parse(text: str) -> Spec:
    """A spec from text that begins with { as JSON, else as YAML, validated."""
    try:
        data = json.loads(text) if text.lstrip().startswith("{") else yaml.safe_load(text)
    except (ValueError, yaml.YAMLError) as e:
        raise SpecError(f"spec is not readable: {e}") from e
    return from_dict(data).checked()


def to_dict(spec: Spec) -> dict:
    """What from_dict reads; a default drift block is left out."""
    columns = []
    for c in spec.columns:
        one: dict[str, Any] = {"name": c.name, "type": c.type}
        if c.source is not None and c.source != c.name:
            one["from"] = c.source
        if c.transform:
            one["transform"] = c.transform
        if c.required:
            one["required"] = True
        columns.append(one)
    source = {"format": spec.input.format} | ({"path": spec.input.path} if spec.input.path else {})
    output: dict[str, Any] = {"format": spec.output.to} | ({"path": spec.output.path} if spec.output.path else {}) | {"compression": spec.output.compression}
    output |= {n: list(v) for n in ("partition_by", "merge_on") if (v := getattr(spec.output, n))}
    options = {"flatten": spec.flatten, "row_group_rows": spec.row_group_rows, "infer_sample": spec.infer_sample}
    out = {"dataset": spec.dataset, "source": source, "output": output, "schema": spec.mode, "columns": columns, "options": options}
    if spec.drift != Drift():
        out["drift"] = {"policy": spec.drift.policy, "rescue_column": spec.drift.rescue_column, "max_examples": spec.drift.max_examples}
    return out


def to_yaml(spec: Spec) -> str:
    return yaml.safe_dump(to_dict(spec), sort_keys=False, allow_unicode=True)


def validate(spec: Spec) -> None:
    from formwright.operators.partition import source_of, split_top

    names = [c.name for c in spec.columns]
    if not spec.dataset.strip():
        raise SpecError("dataset must not be blank")
    if spec.mode == "strict" and not names:
        raise SpecError("a strict schema needs at least one column")
    for name in names:
        if names.count(name) > 1:
            raise SpecError(f"column `{name}` is declared twice")
    if spec.drift.policy == "rescue":
        if not spec.drift.rescue_column.strip():
            raise SpecError("the rescue column must not be blank")
        if spec.drift.rescue_column in names:
            raise SpecError(f"the rescue column `{spec.drift.rescue_column}` is also a declared column")
    entries = [e for text in spec.output.partition_by for e in split_top(text)]
    if spec.mode == "strict":
        for e in entries:
            if source_of(e) not in names:
                raise SpecError(f"partition_by `{e}`: column `{source_of(e)}` is not declared")
    keys = spec.output.merge_on
    if keys and spec.output.to != "iceberg":
        raise SpecError("merge_on needs an iceberg output")
    if len(set(keys)) < len(keys):
        raise SpecError("merge_on names a column twice")
    if spec.mode == "strict":
        for k in keys:
            if k not in names:
                raise SpecError(f"merge_on: column `{k}` is not declared")
    if entries and spec.output.to != "iceberg":
        raise SpecError("partition_by needs an iceberg output")


def effective(spec: Spec, inferred: list[Column] | tuple[Column, ...] = ()) -> tuple[Column, ...]:
    """Declared columns, then, in infer mode, inferred ones whose names are not declared."""
    declared = {c.name for c in spec.columns}
    out = (*spec.columns, *(c for c in inferred if spec.mode == "infer" and c.name not in declared))
    if not out:
        raise SpecError("the spec gives no output columns")
    if spec.drift.policy == "rescue" and spec.drift.rescue_column in {c.name for c in out}:
        raise SpecError(f"the rescue column `{spec.drift.rescue_column}` is also an output column")
    return out
