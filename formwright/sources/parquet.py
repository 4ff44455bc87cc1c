"""Parquet files: one named file, or a folder in a store; and their footers."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from formwright.errors import SinkError
from formwright.plans.spec import CODECS
from formwright.sources.files import Files


def resolved(path: str, dataset: str, files: Files) -> str:
    """A folder, or a path that ends like one, takes <dataset>.parquet."""
    return f"{path.rstrip('/')}/{dataset}.parquet" if path.endswith("/") or files.is_folder(path) and not path.endswith(".parquet") else path


def write_single(df: DataFrame, path: str, codec: str = "snappy", row_group_rows: int | None = None, before: Callable[[], None] = lambda: None) -> int:
    """One file under exactly this name; its bytes. Tasks write a file each, and the row groups of all become one file's, as
    they are, in the tasks' order. The old file stays until the new one is whole. before: runs in between, and may raise."""
    if codec not in CODECS:
        raise SinkError(f"unknown compression {codec}")
    files = Files(df.sparkSession)
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    try:
        writer = df.write.option("compression", codec)
        if row_group_rows:
            writer = writer.option("parquet.block.row.count.limit", str(row_group_rows))
        writer.parquet(f"{staging}/parts")
        before()
        parts = files.walk(f"{staging}/parts", ".parquet")
        if len(parts) > 1:
            join(df.sparkSession, parts, f"{staging}/whole.parquet")
        files.move(f"{staging}/whole.parquet" if len(parts) > 1 else parts[0], path)
    finally:
        files.remove(staging)
    return files.size(path)


def join(spark: SparkSession, parts: list[str], path: str) -> None:
    """One file of the row groups of several, byte by byte: nothing is decoded."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.parquet.hadoop
    source = lambda p: hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(p), conf)
    first = hadoop.ParquetFileReader.open(source(parts[0]))
    try:
        meta = first.getFooter().getFileMetaData()
    finally:
        first.close()
    writer = hadoop.ParquetFileWriter(conf, meta.getSchema(), jvm.org.apache.hadoop.fs.Path(path))
    writer.start()
    for p in parts:
        writer.appendFile(source(p))
    writer.end(meta.getKeyValueMetaData())


def write_text(df: DataFrame, path: str) -> int:
    """Lines (value, seq) as one text file, in order of seq. Ranges of seq are written by a task each, then put one
    after the other. The number of files that took."""
    files = Files(df.sparkSession)
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    try:
        df.repartitionByRange("seq").sortWithinPartitions("seq").select("value").write.text(staging)
        parts = files.walk(staging, ".txt")
        files.concatenate(parts, path)
    finally:
        files.remove(staging)
    return len(parts)


def inspect(spark: SparkSession, path: str) -> dict:
    """Rows, row groups and columns, from footers; of a folder, from all its files."""
    files = Files(spark)
    paths = files.walk(path, ".parquet") if files.is_folder(path) else [path]
    rows = groups = 0
    for p in paths:
        conf = spark._jsc.hadoopConfiguration()
        jvm = spark._jvm
        source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(p), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
        try:
            rows += reader.getRecordCount()
            groups += reader.getRowGroups().size()
        finally:
            reader.close()
    schema = spark.read.parquet(*paths).schema
    return {"rows": rows, "row_groups": groups, "columns": [(f.name, f.dataType.simpleString()) for f in schema.fields]}
