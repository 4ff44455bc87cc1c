"""Streams of JSON lines into tables, a snapshot per batch that has rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formwright.errors import SpecError
from formwright.operators.partition import split_top
from formwright.operators.shape import Shaped
from formwright.plans.spec import Spec
from formwright.sources.lines import records
from formwright.sources.table import Table


def written(table: Table, name: str) -> int:
    """The last batch of a stream that the table holds, or -1."""
    ids = [int(s["summary"][f"stream.{name}"]) for s in (table.meta or {}).get("snapshots", ()) if f"stream.{name}" in s["summary"]]
    return max(ids, default=-1)


def batch_writer(spec: Spec, path: str, name: str = "stream", order=None):
    """For foreachBatch. A batch that was committed before is left out, so a restart repeats nothing. order: a column of the
    raw lines that ranks them; files of a batch come in no order."""
    if not spec.columns and spec.mode == "strict":
        raise SpecError("a strict schema needs at least one column")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table = Table(spark, path)
        if batch_id <= written(table, name) or batch.isEmpty():
            return
        seq = order if order is not None else F.monotonically_increasing_id()
        shaped = Shaped(spec, records(batch.select(seq.cast("long").alias("seq"), F.col("value").alias("raw"))))
        shaped.check()
        mode = "merge" if spec.output.merge_on else "append"
        parts = tuple(e for text in spec.output.partition_by for e in split_top(text))
        table.write(shaped.rows, mode, parts, spec.output.merge_on, spec.output.compression, shaped.schema, {f"stream.{name}": str(batch_id)})

    return write


def drain(spark: SparkSession, source: str | DataFrame, spec: Spec, path: str, checkpoint: str, name: str = "stream", files_per_batch: int | None = None, order=None) -> None:
    """Everything that a source holds now, in batches; later calls go on from there. source: a folder of text files, or a
    streaming DataFrame with a column ``value``, such as ``kafka`` gives."""
    if isinstance(source, str):
        reader = spark.readStream
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        source = reader.text(source)
    stream = source.writeStream.foreachBatch(batch_writer(spec, path, name, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    stream.start().awaitTermination()


def kafka(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """The values of a topic as text, in the order of offset and partition as far as that goes: the stream that ``drain`` takes.
    Needs Spark's Kafka package on the session's path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest")
    return reader.options(**options).load().select(F.col("value").cast("string").alias("value"), "partition", "offset")
