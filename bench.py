"""Times the headline queries and prints one JSON line. BENCH_SF_DIR and BENCH_CPUS say where and with how many threads."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time
from functools import partial
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import functions as F

    from formwright.session import build

    top = tempfile.mkdtemp(prefix="formwright-bench-")
    spark = build("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.sql.files.openCostInBytes": "512k", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"file://{top}/checkpoints"})
    spark.sparkContext.setLogLevel("ERROR")
    from formwright.operators.run import run
    from formwright.plans import queries as Q
    from formwright.plans.spec import Drift, Input, Output, Spec
    from formwright.sources import lines
    from formwright.sources.table import Table

    # the input as a file of JSON lines, as the published numbers have it
    path = f"{top}/events"
    Q.events_json(spark, sf_dir).coalesce(1).select("raw").write.text(path)
    # a million of them, as published
    big = f"{top}/million"
    once = spark.read.text(path)
    times = max(1, round(1_000_000 / once.count()))
    once.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(times)))).select("value").coalesce(1).write.text(big)
    rows = spark.read.text(big).count()
    columns = (Q.Column("id", "int64", required=True), Q.Column("at", "timestamp", "ts"), Q.Column("user", "int64", "user.id"), Q.Column("kind", "string", "type", "uppercase"), Q.Column("value", "float64"), Q.Column("tags", "json"))

    def to_parquet(policy: str = "ignore", own=columns, source: str = big) -> None:
        """The whole command: numbered lines, one file, report and sidecars."""
        run(spark, Spec("bench", Input(path=source), Output("parquet", f"{top}/out/bench.parquet"), mode="infer", columns=own, drift=Drift(policy)))

    def to_table(source: str = big) -> None:
        run(spark, Spec("bench", Input(path=source), Output("iceberg", f"{top}/t"), mode="strict", columns=columns, drift=Drift("ignore")))

    def table(name: str) -> Table:
        return Table(spark, f"{top}/{name}")

    def base() -> None:
        shutil.rmtree(f"{top}/base", ignore_errors=True)
        table("base").write(Q.orders_rows(spark, sf_dir))

    cases = {
        "jsonl_to_parquet": to_parquet,
        "jsonl_to_table": to_table,
        "infer_sample": lambda: Q.infer.infer_columns(lines.sample(lines.read(spark, big, dense=False), 1000)),
        "drift_warn_clean": partial(to_parquet, "warn"),
        "drift_ignore_one_column": partial(to_parquet, "ignore", columns[:1]),
        "drift_warn_all_rows": partial(to_parquet, "warn", columns[:1]),
        "drift_rescue_all_rows": partial(to_parquet, "rescue", columns[:1]),
        "append": lambda: table("base").write(Q.upserts(spark, sf_dir).drop("__seq"), "append"),
        "merge": lambda: table("base").write(Q.upserts(spark, sf_dir), "merge", (), ("id",)),
        **{n: (lambda n=n: Q.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()) for n in ("q_shape_billing", "q_latest_per_key", "q_cdc_current", "q_cdc_merge_delete", "q_drift_rescue", "q_part_bucket_long", "q_json_array")},
    }
    took = {}
    for name, case in cases.items():
        if name in ("append", "merge"):
            base()
        case(**({"source": path} if name.startswith(("jsonl", "drift")) else {}))  # the session is warm, as the published figures' process is
        if name in ("append", "merge"):
            base()
        began = time.perf_counter()
        case()
        took[name] = round(time.perf_counter() - began, 3)
        print(name, took[name], file=sys.stderr)
    shutil.rmtree(top, ignore_errors=True)
    rate = {n: round(rows / took[n]) for n in ("jsonl_to_parquet", "jsonl_to_table")}
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name, "rows": rows, "rows_per_second": rate}))


if __name__ == "__main__":
    main()
