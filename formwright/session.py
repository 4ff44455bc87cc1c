"""Sessions, and getting this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: What the plans of this package rely on. JSON keys are case-sensitive, and of repeated keys the last holds.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build(name: str = "formwright", master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | {"spark.sql.adaptive.enabled": "true"} | more)
    return prepared((builder.master(master) if master else builder).getOrCreate())


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings above, and with this package on its executors' path. Safe to call again."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return shipped(spark)


#: Between an executor and a Python worker, a batch is a few copies of this: of long texts, 10,000 rows would be far more.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def shipped(spark: SparkSession) -> SparkSession:
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)
    context = spark.sparkContext
    if not getattr(context, "_formwright", False):
        top = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="formwright-")
        path = os.path.join(folder, "formwright_package.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as to:
            for p in sorted(top.rglob("*.py")):
                to.write(p, p.relative_to(top.parent))
        context.addPyFile(path)
        context._formwright = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Where data that tasks write and read again belongs: the folder that the session names. A folder of this machine will do only
    where all of Spark runs on it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="formwright-")
