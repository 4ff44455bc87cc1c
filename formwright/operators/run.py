"""One run: spec and input to table or file, with its report and sidecars."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Observation, SparkSession

from formwright.errors import EngineError, SpecError
from formwright.operators.partition import split_top
from formwright.operators.shape import Report, Shaped
from formwright.plans.spec import Spec
from formwright.sources import lines, parquet
from formwright.sources.files import Files
from formwright.sources.table import Summary, Table


@dataclass
class Result:
    report: Report
    path: str
    table: Summary | None = None
    bytes: int = 0
    row_groups: int = 0
    rejects_path: str | None = None
    drift_path: str | None = None


def sidecar(output: str, dataset: str) -> str:
    """Where sidecars begin: next to the output, or here for an output in a store."""
    return dataset if "://" in output else output


def run(spark: SparkSession, spec: Spec, records: lines.Records | None = None) -> Result:
    spec = spec.checked()
    if spec.output.to == "parquet" and (spec.output.partition_by or spec.output.append):
        raise SpecError("partition_by and append need an iceberg output")
    if not spec.output.path:
        raise SpecError("no output path")
    files = Files(spark)
    if records is None:
        if not spec.input.path:
            raise SpecError("no input path: give one with --input or in the spec")
        records = lines.read(spark, lines.spooled(spec.input.path), spec.input.format)
    base = sidecar(spec.output.path, spec.dataset)
    for end in (".rejects.jsonl", ".drift.json"):
        if files.exists(base + end):
            files.remove(base + end)
    shaped = Shaped(spec, records)

    def tell(report: Report) -> str | None:
        if report.drift.is_clean():
            return None
        body = {"dataset": spec.dataset, "drift": report.drift.as_dict(), "suggested_columns": [{"name": c.name, "type": c.type} for c in report.drift.suggested_columns()]}
        files.write(f"{base}.drift.json", json.dumps(body, indent=2, ensure_ascii=False).encode())
        return f"{base}.drift.json"

    # one pass shapes, counts and writes; whatever stops the run comes before anything is put in place
    seen = Observation()
    rows = shaped.shaped(shaped.outcomes.observe(seen, *shaped.counts()))
    out: list[Result] = []

    def before() -> None:
        counts = seen.get
        done = Result(shaped.report(counts), "")
        try:
            shaped.told(counts)
        except EngineError:
            tell(done.report)
            raise
        if done.report.rejected or done.report.parse_errors:
            parquet.write_text(shaped.rejects, f"{base}.rejects.jsonl")
            done.rejects_path = f"{base}.rejects.jsonl"
        done.drift_path = tell(done.report)
        out.append(done)

    if spec.output.to == "parquet":
        path = parquet.resolved(spec.output.path, spec.dataset, files)
        size = parquet.write_single(rows.drop("__seq"), path, spec.output.compression, spec.row_group_rows, before)
        out[0].path, out[0].bytes, out[0].row_groups = path, size, parquet.inspect(spark, path)["row_groups"]
        return out[0]
    mode = "merge" if spec.output.merge_on else "append" if spec.output.append else "create"
    parts = tuple(e for text in spec.output.partition_by for e in split_top(text))
    done = Table(spark, spec.output.path).write(rows, mode, parts, spec.output.merge_on, spec.output.compression, shaped.schema, before=before)
    out[0].path, out[0].table, out[0].bytes, out[0].row_groups = spec.output.path, done, done.bytes, done.files
    return out[0]


class Feed:
    """Lines given one after the other, and written together: for a program that makes records itself.

    What is pushed stays in the driver until the flush, so a flush belongs after every so many lines.
    """

    def __init__(self, spark: SparkSession, spec: Spec):
        self.spark, self.spec = spark, spec
        self.lines: list[str] = []

    def push(self, *records: str | dict) -> None:
        self.lines += [r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in records]

    def flush(self) -> Result | None:
        """The run over what was pushed since the last one; None if that is nothing."""
        if not self.lines:
            return None
        rows = self.spark.createDataFrame(list(enumerate(self.lines, 1)), lines.RAW)
        done = run(self.spark, self.spec, lines.records(rows))
        self.lines = []
        return done
