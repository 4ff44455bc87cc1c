"""A local HTTP console: JSON in, JSON out, over the same functions as the command line."""

from __future__ import annotations

import json
import re
import shutil
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

from pyspark.sql import SparkSession

from formwright import __version__
from formwright.cli import inferred
from formwright.errors import EngineError, SpecError
from formwright.operators.cost import estimate
from formwright.operators.partition import split_top
from formwright.operators.run import run
from formwright.plans import spec as S
from formwright.sources import lines, parquet
from formwright.sources.files import Files
from formwright.sources.table import Table

MOST_BODY = 64 * 1024 * 1024
MOST_REJECTS, MOST_DRIFT = 200, 25
_PAGE = """<!doctype html><meta charset="utf-8"><title>formwright</title><h1>formwright</h1>
<p>POST JSON to /api/infer, /api/shape, /api/inspect or /api/cost; GET /api/health.</p>"""


def clean(name: str | None) -> str:
    """A dataset's name as a file's name."""
    return re.sub(r"[^A-Za-z0-9_-]", "_", (name or "").strip())[:64].strip("_") or "dataset"


class Console:
    def __init__(self, spark: SparkSession, data_dir: str):
        self.spark, self.top = spark, Path(data_dir).resolve()

    def health(self, _: dict) -> dict:
        return {"status": "ok", "version": __version__}

    def infer(self, a: dict) -> dict:
        spec, n = inferred(self.spark, None, a.get("input", ""), a.get("format", "jsonl"), int(a.get("sample", 1000)), bool(a.get("flatten", True)), clean(a.get("dataset")))
        return {"dataset": spec.dataset, "spec_yaml": S.to_yaml(spec), "columns": [{"name": c.name, "type": c.type} for c in spec.columns], "sampled": n}

    def shape(self, a: dict) -> dict:
        name = clean(a.get("dataset"))
        spec = S.parse(a["spec_yaml"]) if a.get("spec_yaml") else S.Spec(name)
        name = clean(a.get("dataset") or spec.dataset)
        to = a.get("to") or spec.output.to
        parts = a.get("partition_by")
        parts = tuple(e for t in ([parts] if isinstance(parts, str) else parts) for e in split_top(t)) if parts else spec.output.partition_by
        path = self.top / (name if to == "iceberg" else f"{name}.parquet")
        if to == "parquet" and (parts or a.get("append")):
            raise SpecError("partition_by and append need an iceberg output")
        self.top.mkdir(parents=True, exist_ok=True)
        if to == "iceberg" and not a.get("append") and not spec.output.merge_on and path.exists():
            shutil.rmtree(path)
        form = a.get("format") or spec.input.format
        drift = S.dataclasses.replace(spec.drift, policy=a["on_drift"]) if a.get("on_drift") else spec.drift
        out = S.dataclasses.replace(spec.output, to=to, path=str(path), compression=a.get("compression") or spec.output.compression, append=bool(a.get("append")), partition_by=parts)
        records = lines.read_text(self.spark, a["input"], form) if a.get("input") is not None else lines.read(self.spark, a.get("input_path") or "", form)
        r = run(self.spark, spec.replace(dataset=name, output=out, drift=drift), records)
        d = r.report.drift
        rejects = [json.loads(x) for x in Path(r.rejects_path).read_text().splitlines()[:MOST_REJECTS]] if r.rejects_path else []
        form_of = lambda m: [{"path": x.path, "count": x.count, "first_record": x.first_record, "type": x.type, "examples": x.examples} for x in list(m.values())[:MOST_DRIFT]]
        return {
            "path": r.path, "rows_in": r.report.rows_in, "rows_out": r.report.rows_out, "rejected": r.report.rejected, "parse_errors": r.report.parse_errors, "bytes": r.bytes, "rejects": rejects,
            "drift": {"rows_with_drift": d.rows_with_drift, "new_fields": form_of(d.new_fields), "type_mismatches": form_of(d.type_mismatches), "suggested_columns": [{"name": c.name, "type": c.type} for c in d.suggested_columns()]},
            "merge": vars(r.table.merge) if r.table and r.table.merge else None,
        }

    def inspect(self, a: dict) -> dict:
        path = a.get("path") or ""
        return Table(self.spark, path).inspect() if "://" in path or Files(self.spark).is_folder(path) else parquet.inspect(self.spark, path)

    def cost(self, a: dict) -> dict:
        rows = int(a["rows"]) if a.get("rows") is not None else lines.read_text(self.spark, a.get("input", ""), a.get("format", "jsonl")).good.count()
        e = estimate(rows, float(a["vendor_per_million"]), float(a.get("self_host_cost", 0)))
        return {"rows": e.rows, "vendor": e.vendor, "self_host": e.self_host, "saved": e.saved, "fraction": e.fraction}


def server(spark: SparkSession, addr: str, data_dir: str, hosts: list[str], any_host: bool = False) -> ThreadingHTTPServer:
    host, _, port = addr.rpartition(":")
    console = Console(spark, data_dir)
    routes = {"/api/health": ("GET", console.health), **{f"/api/{n}": ("POST", getattr(console, n)) for n in ("infer", "shape", "inspect", "cost")}}
    allowed = {"127.0.0.1", "localhost", "[::1]", host, *hosts}

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, body: bytes, kind: str = "application/json") -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.send_header("Content-Security-Policy", "default-src 'self'")
            self.end_headers()
            self.wfile.write(body)

        def fail(self, status: int, text: str) -> None:
            self.answer(status, json.dumps({"error": text}).encode())

        def handle_one(self, method: str) -> None:
            if not any_host and re.sub(r":\d+$", "", self.headers.get("Host", "")) not in allowed:
                return self.fail(403, "host not allowed")
            if self.path == "/" and method == "GET":
                return self.answer(200, _PAGE.encode(), "text/html; charset=utf-8")
            if self.path not in routes:
                return self.fail(404, "not found")
            wanted, f = routes[self.path]
            if method != wanted:
                return self.fail(405, f"use {wanted}")
            size = int(self.headers.get("Content-Length") or 0)
            if size > MOST_BODY:
                return self.fail(413, "body too large")
            if method == "POST" and self.headers.get("Content-Type", "").split(";")[0].strip() != "application/json":
                return self.fail(415, "send application/json")
            try:
                self.answer(200, json.dumps(f(json.loads(self.rfile.read(size) or b"{}")), default=str).encode())
            except (EngineError, ValueError, KeyError, OSError) as e:
                self.fail(400, str(e))

        def do_GET(self) -> None:
            self.handle_one("GET")

        def do_POST(self) -> None:
            self.handle_one("POST")

        def do_PUT(self) -> None:
            self.handle_one("PUT")

        do_DELETE = do_PUT

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host or "127.0.0.1", int(port)), Handler)


def serve(spark: SparkSession, addr: str, data_dir: str, hosts: list[str], any_host: bool = False) -> None:
    with server(spark, addr, data_dir, hosts, any_host) as s:
        print(f"listening on http://{addr}", flush=True)
        s.serve_forever()
