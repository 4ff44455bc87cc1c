"""The command line: infer, shape, inspect, cost, serve."""

from __future__ import annotations

import argparse
import logging
import os
import sys
from pathlib import Path

from formwright.errors import EngineError, SpecError
from formwright.operators.cost import estimate
from formwright.operators.infer import infer_columns
from formwright.operators.partition import split_top
from formwright.operators.run import Result, run
from formwright.plans import spec as S
from formwright.session import build
from formwright.sources import lines, parquet
from formwright.sources.files import Files
from formwright.sources.table import Table


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="formwright", description="JSON to typed tables on Spark")
    top.add_argument("-v", "--verbose", action="count", default=0)
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("infer", help="print a spec for an input")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("--format", choices=S.FORMATS, default="jsonl")
    p.add_argument("--sample", type=int, default=1000)
    p.add_argument("--no-flatten", action="store_true")
    p.add_argument("--dataset")
    p.add_argument("-o", "--out")
    p = sub.add_parser("shape", help="write an input as a table")
    for flag in ("-s/--spec", "-i/--input", "-o/--output", "--dataset", "--rescue-column"):
        p.add_argument(*flag.split("/"))
    p.add_argument("--format", choices=S.FORMATS)
    p.add_argument("--to", choices=S.TARGETS)
    p.add_argument("--compression", choices=S.CODECS)
    p.add_argument("--append", action="store_true")
    p.add_argument("--partition-by", action="append", default=[])
    p.add_argument("--merge-on", action="append", default=[])
    p.add_argument("--on-drift", choices=S.POLICIES)
    p.add_argument("--pipeline", choices=("auto", "on", "off"), default="auto", help="accepted; Spark overlaps reading and writing by itself")
    p = sub.add_parser("inspect", help="describe a Parquet file or a table")
    p.add_argument("path")
    p = sub.add_parser("cost", help="what the rows would cost")
    p.add_argument("--rows", type=int)
    p.add_argument("-i", "--input")
    p.add_argument("--format", choices=S.FORMATS, default="jsonl")
    p.add_argument("--vendor-per-million", type=float, required=True)
    p.add_argument("--self-host-cost", type=float, default=0.0)
    p = sub.add_parser("serve", help="a local console over the same four")
    p.add_argument("--addr", default="127.0.0.1:8087")
    p.add_argument("--data-dir", default="formwright-data")
    p.add_argument("--allow-host", action="append", default=[])
    p.add_argument("--allow-any-host", action="store_true")
    return top


def dataset_of(path: str) -> str:
    return "dataset" if lines.is_stdin(path) else Path(path.rstrip("/")).stem or "dataset"


def spec_from(a: argparse.Namespace) -> S.Spec:
    """The spec file, if any, then flags over it. --format and --dataset count only without one."""
    if a.spec:
        spec = S.parse(Path(a.spec).read_text())
    else:
        if not a.input or not a.output:
            raise SpecError("without --spec, --input and --output are needed")
        spec = S.Spec(a.dataset or dataset_of(a.input), input=S.Input(a.format or "jsonl"))
    source, out, drift = spec.input, spec.output, spec.drift
    changed = lambda x, **k: S.dataclasses.replace(x, **{n: v for n, v in k.items() if v})
    out = changed(out, path=a.output, to=a.to, compression=a.compression, append=a.append, partition_by=tuple(e for t in a.partition_by for e in split_top(t)), merge_on=tuple(k.strip() for t in a.merge_on for k in t.split(",") if k.strip()))
    return spec.replace(input=changed(source, path=a.input), output=out, drift=changed(drift, policy=a.on_drift, rescue_column=a.rescue_column)).checked()


def told(r: Result) -> list[str]:
    out = [r.report.line(r.row_groups, r.bytes)]
    if r.rejects_path:
        out.append(f"rejects: {r.rejects_path}")
    if r.table:
        out.append(f"metadata: {r.table.metadata}")
        if m := r.table.merge:
            out.append(f"merge: {m.distinct_keys} key(s) — {m.keys_updated} updated, {m.keys_inserted} inserted; {m.prior_rows_replaced} prior row(s) replaced")
            out.append(f"  {m.duplicates_in_input} duplicate(s) in the input, {m.null_key_rows} row(s) without a key, {m.data_files_scanned} file(s) scanned, {m.data_files_pruned} pruned, {m.position_deletes} position delete(s) in {m.delete_files} file(s)")
    d = r.report.drift
    if not d.is_clean():
        out.append(f"drift: {d.rows_with_drift} of {d.scanned} record(s), {len(d.new_fields)} new field(s), {len(d.type_mismatches)} type mismatch(es)")
        for x in [*d.new_fields.values(), *d.type_mismatches.values()][:5]:
            out.append(f"  {x.path}: {x.count} time(s), first at record {x.first_record}, {x.type}, e.g. {', '.join(x.examples)}")
        out.append(f"  report: {r.drift_path}")
    return out


def described(spark, path: str) -> list[str]:
    files = Files(spark)
    if "://" in path or files.is_folder(path):
        i = Table(spark, path).inspect()
        more = f" ({i['total-records']} written, {i['total-position-deletes']} removed by position deletes)" if i.get("total-position-deletes") else ""
        return [f"format-version: {i['format-version']}", f"table-uuid: {i['table-uuid']}", f"snapshot-id: {i['snapshot-id']}", f"live-records: {i['live-records']}{more}", f"data-files: {i.get('total-data-files', 0)}", *(f"  {f['id']}: {f['name']} {f['type']}{' required' if f['required'] else ''}" for f in i["fields"])]
    i = parquet.inspect(spark, path)
    return [f"rows: {i['rows']}", f"row-groups: {i['row_groups']}", *(f"  {n} {t}" for n, t in i["columns"])]


def inferred(spark, path: str | None, text: str | None, form: str, n: int, flatten: bool, dataset: str) -> tuple[S.Spec, int]:
    records = lines.read_text(spark, text, form) if text is not None else lines.read(spark, lines.spooled(path), form)
    taken = lines.sample(records, n)
    columns = infer_columns(taken, flatten)
    count = taken.count()
    if not count:
        raise EngineError("no records to infer from")
    return S.Spec(dataset, input=S.Input(form, path if path and not lines.is_stdin(path) else None), columns=columns, flatten=flatten, infer_sample=n), count


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=[logging.WARNING, logging.INFO, logging.DEBUG][min(a.verbose, 2)])
    try:
        if a.command == "cost" and a.rows is not None:
            print(estimate(a.rows, a.vendor_per_million, a.self_host_cost).text())
            return 0
        if a.command == "shape":
            spec = spec_from(a)
            if lines.is_stdin(spec.input.path or "") and spec.infer_sample == 0 and spec.mode == "infer":
                raise SpecError("infer_sample 0 needs an input that can be read twice")
        spark = build(master=os.environ.get("FORMWRIGHT_MASTER"), **{"spark.ui.showConsoleProgress": "false"})
        if a.command == "infer":
            spec, _ = inferred(spark, a.input, None, a.format, a.sample, not a.no_flatten, a.dataset or dataset_of(a.input))
            text = S.to_yaml(spec)
            Path(a.out).write_text(text) if a.out else print(text, end="")
        elif a.command == "shape":
            print("\n".join(told(run(spark, spec))))
        elif a.command == "inspect":
            print("\n".join(described(spark, a.path)))
        elif a.command == "cost":
            if not a.input:
                raise SpecError("cost needs --rows or --input")
            rows = lines.read(spark, lines.spooled(a.input), a.format).good.count()
            print(estimate(rows, a.vendor_per_million, a.self_host_cost).text())
        else:
            from formwright.console import serve

            serve(spark, a.addr, a.data_dir, a.allow_host, a.allow_any_host)
    except EngineError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
