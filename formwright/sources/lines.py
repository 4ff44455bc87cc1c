"""JSON Lines, JSON arrays and in-memory lines as numbered raw records, good and bad apart."""

from __future__ import annotations

import os
import re
import shutil
import sys
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formwright.errors import SourceError
from formwright.plans.fence import fenced
from formwright.sources.files import Files

#: The largest record that is read; a longer one is a reject.
MOST_BYTES = 256 * 1024 * 1024
_FEW_BLOCKS = 200_000
RAW = T.StructType([T.StructField("seq", T.LongType()), T.StructField("raw", T.StringType())])


@dataclass(frozen=True)
class Records:
    """good: (seq, raw, v), v the record as a variant. bad: (line, error, raw). Both are lazy, over one scan each. lines: the
    (seq, raw) that both come from, blank ones left out, and most_bytes, what a record may have."""

    good: DataFrame
    bad: DataFrame
    lines: DataFrame
    most_bytes: int
    #: Rows of bad that come from no line: where an array ends or breaks.
    faults: DataFrame | None = None
    #: The text files that the lines come from, if each of their lines is one.
    path: str | None = None

    def broken(self) -> int:
        return 0 if self.faults is None else self.faults.count()


def numbered(files: DataFrame) -> DataFrame:
    """(seq, raw) of text lines with their file and block: the dense 1-based number of the line in reading order.

    monotonically_increasing_id ascends within a block. Blocks are counted in one narrow pass and put in order of
    path and offset; their running totals come back by a join on the block, small against the lines.
    """
    own = files.select("raw", F.col("_metadata.file_path").alias("_p"), F.col("_metadata.file_block_start").alias("_s")).withColumn("_i", F.monotonically_increasing_id())
    blocks = own.groupBy("_p", "_s").agg(F.count("*").alias("n"), F.min("_i").alias("least")).collect()
    if len(blocks) <= 1:
        return own.select((F.col("_i") + 1 - (blocks[0].least if blocks else 0)).alias("seq"), "raw")
    rows, before = [], 0
    for b in sorted(blocks, key=lambda b: (b["_p"], b["_s"])):
        rows.append((b["_p"], b["_s"], before - b.least + 1))
        before += b.n
    table = files.sparkSession.createDataFrame(rows, "_p string, _s long, _add long")
    # broadcast as far as its size is known to be small: lines then stay where they are, in their order
    return own.join(F.broadcast(table) if len(rows) <= _FEW_BLOCKS else table, ["_p", "_s"]).select((F.col("_i") + F.col("_add")).alias("seq"), "raw")


def jsonl(spark: SparkSession, path: str | list[str], dense: bool = True) -> DataFrame:
    """(seq, raw) of one or several text files or folders. Without dense, seq ascends but has gaps, and costs no pass."""
    df = spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("raw"), "_metadata")
    return numbered(df) if dense else df.select((F.monotonically_increasing_id() + 1).alias("seq"), "raw")


def inline(spark: SparkSession, text: str) -> DataFrame:
    """(seq, raw) of lines given as text."""
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines, 1)], RAW)


def rows_as_json(df: DataFrame, seq: Column) -> DataFrame:
    """(seq, raw): each row as a JSON record; of a database table, for instance. Nulls are written."""
    return df.select(seq.cast("long").alias("seq"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}).alias("raw"))


def increment(df: DataFrame, column: str, last, upper) -> DataFrame:
    """Rows past the last watermark and up to the one taken before the pull."""
    return df.where((F.col(column) > F.lit(last)) & (F.col(column) <= F.lit(upper)))


def records(lines: DataFrame, most_bytes: int = MOST_BYTES) -> Records:
    """Blank lines vanish, after numbering. What is not one JSON value, or too long, is bad, and reading goes on.

    A variant parser stops after the first value. So each line is parsed in two frames, as an array's only element and as an
    object's only value: whatever follows the value breaks one of them, or makes a second element.
    """
    some = lines.where(F.col("raw").isNotNull() & ~F.col("raw").rlike(r"^[\s]*$"))
    small = fits(F.col("raw"), most_bytes)
    parsed = some.select("seq", "raw", small.alias("fits"), *framed(F.when(small, F.col("raw"))))
    parsed = fenced(parsed.select("seq", "raw", "fits", *unframed()))
    ok = F.col("fits") & F.col("w") & F.col("v").isNotNull()
    return Records(parsed.where(ok).select("seq", "raw", "v"), parsed.where(~ok).select(*reject(most_bytes)), some, most_bytes)


def fits(raw: Column, most_bytes: int) -> Column:
    return F.octet_length(raw) <= most_bytes


def framed(raw: Column) -> tuple[Column, Column]:
    """The record's two frames, as a and w; then ``unframed`` gives w, whether both hold, and v, the record."""
    array, wrapped = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"r":'), raw, F.lit("}")))
    return array.alias("a"), wrapped.isNotNull().alias("w")


def unframed() -> tuple[Column, Column]:
    return (F.col("w") & F.try_variant_get("a", "$[1]", "variant").isNull()).alias("w"), F.try_variant_get("a", "$[0]", "variant").alias("v")


def reject(most_bytes: int) -> tuple[Column, Column, Column]:
    """(line, error, raw) of (seq, fits, raw)."""
    error = F.when(~F.col("fits"), F.lit(f"record exceeds {most_bytes} bytes")).otherwise(F.lit("not a valid JSON value"))
    return F.col("seq").alias("line"), error.alias("error"), F.regexp_replace("raw", r"[ \r]+$", "").alias("raw")


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"?|[\[\]{},]', re.S)


def elements(text: str) -> Iterator[tuple[int, str | None, str | None]]:
    """(index from 1, raw, error) of a top-level array. Elements are cut at commas outside strings and brackets; an error
    of structure is given once, with the element's index, or 0 where the text is no array at all, and ends it."""
    body = text.lstrip("﻿ \t\r\n")
    if not body.startswith("["):
        yield 0, None, "input is empty" if not body else "input is not a JSON array"
        return
    depth, begin, index, some = 0, 1, 0, False
    for m in _TOKEN.finditer(body, 1):
        c = m.group()
        if c in "[{":
            depth += 1
        elif c in "]}" and depth:
            depth -= 1
        elif c == "}" and not depth:
            yield index + 1, None, "stray `}` in the array"
            return
        elif c in ",]" and not depth:
            part = body[begin : m.start()].strip(" \t\r\n")
            if part:
                index += 1
                yield index, part, None
            elif c == "," or some:
                yield index + 1, None, "trailing comma in the array" if c == "]" else "missing element in the array"
                return
            some, begin = c == ",", m.end()
            if c == "]":
                if body[m.end() :].strip(" \t\r\n"):
                    yield index + 1, None, "trailing content after the array"
                return
    rest = body[begin:].strip(" \t\r\n")
    yield index + 1, None, f"the array is truncated{' in an element' if rest else ''}"


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0).to_pylist():
            buffer: list[tuple[int, str | None, str | None]] = []
            for row in elements(text):
                buffer.append(row)
                if len(buffer) == 10_000:
                    yield pa.RecordBatch.from_pylist([dict(zip(("seq", "raw", "error"), r, strict=True)) for r in buffer], schema=_SPLIT)
                    buffer = []
            if buffer:
                yield pa.RecordBatch.from_pylist([dict(zip(("seq", "raw", "error"), r, strict=True)) for r in buffer], schema=_SPLIT)


_SPLIT = pa.schema([("seq", pa.int64()), ("raw", pa.string()), ("error", pa.string())])


_SCAN = re.compile(r'"(?:[^"\\]|\\.)*("?)|[\[\]{},]', re.S)
_STRING = re.compile(r'(?:[^"\\]|\\.)*("?)', re.S)
_OUTLINE = "f long, s long, inside boolean, bytes long, head string, closed boolean, delta long, low long, levels array<long>, counts array<long>, size long"
_PARTS = "f long, seq long, s long, raw string, error string, kind string"
_ENDS = {",": "missing element in the array", "]": "trailing comma in the array", "}": "stray `}` in the array"}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, str]]:
    """(file, block, size of the file, text) of pieces between commas, in order. Each has the comma before it, but for a file's first."""
    for batch in batches:
        f, s = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = [0, *(1 + i for i in range(len(f) - 1) if f[i] != f[i + 1] or s[i] != s[i + 1])] if len(f) and (f[0] != f[-1] or s[0] != s[-1] or f.min() != f.max() or s.min() != s.max()) else [0]
        for lo, hi in zip(cuts, [*cuts[1:], len(f)], strict=True):
            if hi > lo:
                yield int(f[lo]), int(s[lo]), batch.column(2)[lo].as_py(), "," + ",".join(batch.column(3).slice(lo, hi - lo).to_pylist())


def _headed(text: str) -> tuple[str | None, str]:
    """What is wrong with a file's first text, and what follows its bracket."""
    body = text[1:].lstrip("\ufeff \t\r\n")
    return (None, body[1:]) if body.startswith("[") else ("input is not a JSON array" if body else "input is empty", body)


def _tokens(text: str, inside: bool) -> Iterator[tuple[str, int, bool]]:
    """(bracket or comma, place, False); at the end ("", length, whether a string is open)."""
    at = 0
    if inside:
        m = _STRING.match(text)
        at, inside = m.end(), not m.group(1)
    if not inside:
        for m in _SCAN.finditer(text, at):
            c = m.group()
            if c[0] != '"':
                yield c, m.start(), False
            else:
                inside = not m.group(1)
    yield "", len(text), inside


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block, for both states it can begin in: how brackets go on, and the commas at the lowest depth so far, by that depth."""
    got: dict[tuple[int, int, bool], dict] = {}
    for f, s, size, text in _blocks(batches):
        n, head, first = len(text.encode("utf-8", "surrogatepass")), None, s == 0 and (f, s, False) not in got
        if first:
            head, text = _headed(text)
            if head is None and text.lstrip(" \t\r\n").startswith("]"):
                head = "]"  # an array without elements
        for inside in (False, True):
            o = got.setdefault((f, s, inside), {"f": f, "s": s, "inside": inside, "bytes": 0, "head": head, "closed": inside, "delta": 0, "low": 0, "n": {}, "size": size})
            o["bytes"] += n
            depth, low, counts = o["delta"], o["low"], o["n"]
            for c, _, open_ in _tokens(text, o["closed"]):
                if c == ",":
                    if depth == low:
                        counts[low] = counts.get(low, 0) + 1
                elif c in ("[", "{"):
                    depth += 1
                elif c:
                    depth -= 1
                    low = min(low, depth)
                else:
                    o["closed"] = open_
            o["delta"], o["low"] = depth, low
    rows = [{k: v for k, v in o.items() if k != "n"} | {"levels": list(o["n"]), "counts": list(o["n"].values())} for o in got.values()]
    longs = ("f", "s", "bytes", "delta", "low", "size")
    kinds = {**dict.fromkeys(longs, pa.int64()), "inside": pa.bool_(), "closed": pa.bool_(), "head": pa.string(), "levels": pa.list_(pa.int64()), "counts": pa.list_(pa.int64())}
    names = [x.split(" ")[0] for x in _OUTLINE.split(", ")]
    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, kinds[n]) for n in names]))


def _cut(plan: dict[tuple[int, int], tuple[bool, int, int, bool, bool, bool]]):
    """plan: of a block, whether it begins in a string, its depth and element, and whether the array was over, whether the file ends
    with it, and whether in a comma. Elements come whole, or in fragments (kind: what ended it, + if that is in a later block)."""
    schema = pa.schema([("f", pa.int64()), ("seq", pa.int64()), ("s", pa.int64()), ("raw", pa.string()), ("error", pa.string()), ("kind", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, buffer, inside, depth, seq, over, whole = None, [], False, 0, 0, False, False

        def finished():
            if at is None or over:
                return
            last, comma = plan[at][4:]
            if not last:
                yield at[0], seq, at[1], "".join(buffer), None, "+"
            elif comma and not inside and depth == 0:
                # the file's last comma parts elements
                yield at[0], seq, at[1], "".join(buffer), None, ","
                yield at[0], seq + 1, at[1], "", None, "open"
            else:
                yield at[0], seq, at[1], "".join(buffer) + ("," if comma else ""), None, "open"

        for f, s, _, text in _blocks(batches):
            if (f, s) != at:
                yield from finished()
                at, buffer = (f, s), []
                inside, depth, seq, over = plan[at][:4]
                whole = s == 0
                if over:
                    yield f, seq + 1, s, None, "trailing content after the array", None
                if s == 0:
                    text = _headed(text)[1]
            elif over:
                if over == "]":
                    over = True
                    yield f, seq + 1, s, None, "trailing content after the array", None
            if over:
                continue
            begin = 0
            for c, place, open_ in _tokens(text, inside):
                if not c:
                    inside = open_
                    buffer.append(text[begin:])
                elif c in "[{":
                    depth += 1
                elif c in "]}" and depth:
                    depth -= 1
                elif not depth:
                    part = "".join(buffer) + text[begin:place]
                    buffer, begin = [], place + 1
                    if c == "}":
                        yield f, seq, s, None, _ENDS[c], None
                    elif not whole:
                        yield f, seq, s, part, None, c
                    elif part := part.strip(" \t\r\n"):
                        yield f, seq, s, part, None, None
                    elif c == "," or seq > 1:
                        yield f, seq, s, None, _ENDS[c], None
                    whole = True
                    if c == ",":
                        seq += 1
                    else:
                        over = c
                        if c == "]" and (text[begin:].strip(" \t\r\n") or plan[at][5]):
                            over = True
                            yield f, seq + 1, s, None, "trailing content after the array", None
                        break
        yield from finished()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batched(rows(batches), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)

    return cut


def _array_parts(spark: SparkSession, path: str) -> DataFrame:
    """(f, seq, raw, error) of files that each hold one array, in blocks that are cut by all tasks.

    Files are read as pieces between commas, so that Spark may split them anywhere. A first pass outlines each block for both states it
    can begin in, in a string or not; the driver goes through these, one row or two for each block, and tells each block its state.
    A second pass cuts. Elements that go on in another block are put together by their number.
    """
    files = spark.read.option("lineSep", ",").text(path)
    own = files.select(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"), F.col("_metadata.file_size").alias("size"), "value")
    seen: dict[int, dict[int, dict[bool, Row]]] = {}
    for r in own.mapInArrow(_outline, _OUTLINE).collect():
        seen.setdefault(r.f, {}).setdefault(r.s, {})[r.inside] = r
    if not seen:
        raise SourceError("input is empty")
    plan = {}
    for f, blocks in seen.items():
        inside, depth, seq, over = False, 0, 1, False
        # a comma at the very end is no piece; a mark of byte order may have been left out
        missing = blocks[0][False].size - sum(b[False].bytes for b in blocks.values()) + 1
        for k, s in enumerate(sorted(blocks)):
            r = blocks[s][inside]
            if r.head == "]":
                seq = 0
            elif r.head:
                raise SourceError(r.head)
            plan[f, s] = (inside, depth, seq, over, k == len(blocks) - 1, k == len(blocks) - 1 and missing in (1, 4))
            if not over:
                seq += dict(zip(r.levels, r.counts, strict=True)).get(-depth, 0)
                over = depth + r.low < 0
                inside, depth = r.closed, depth + r.delta
    parts = own.mapInArrow(_cut(plan), _PARTS)
    ends = parts.where("kind is not null").groupBy("f", "seq").agg(F.sort_array(F.collect_list(F.struct("s", "raw", "kind"))).alias("x"))
    joined = ends.select("f", "seq", F.expr(r"trim(BOTH ' \t\r\n' FROM array_join(transform(x, y -> y.raw), ''))").alias("raw"), F.expr("element_at(x, -1).kind").alias("kind"))
    error = F.when(F.col("kind") == "open", F.concat(F.lit("the array is truncated"), F.when(F.col("raw") != "", " in an element").otherwise("")))
    error = error.when((F.col("raw") == "") & ((F.col("kind") == ",") | (F.col("seq") > 1)), F.when(F.col("kind") == ",", _ENDS[","]).otherwise(_ENDS["]"]))
    # what stands before a stray bracket is told by its error alone
    joined = joined.where("kind <> '+'").select("f", "seq", F.when(error.isNull(), F.col("raw")).alias("raw"), error.alias("error")).where("error is not null or raw <> ''")
    parts = parts.where("kind is null").select("f", "seq", "raw", "error").unionAll(joined)
    # an error ends a file's array: what follows it counts no more
    first = {r.f: r.seq for r in parts.where("error is not null").groupBy("f").agg(F.min("seq").alias("seq")).collect()}
    if first:
        table = spark.createDataFrame(list(first.items()), "f long, _first long")
        kept = parts.join(F.broadcast(table), "f", "left")
        faults = kept.where("error is not null and seq = _first").groupBy("f", "seq").agg(F.lit(None).cast("string").alias("raw"), F.min("error").alias("error"))
        parts = kept.where("error is null and (_first is null or seq < _first)").select("f", "seq", "raw", "error").unionAll(faults)
    return parts


def json_array(spark: SparkSession, path: str | None = None, text: str | None = None, most_bytes: int = MOST_BYTES) -> Records:
    """Records of files that each hold one array; seq is the element's index. A file that is no array raises."""
    if text is None:
        parts = _array_parts(spark, path)
    else:
        parts = spark.createDataFrame([(text,)], "value string").mapInArrow(_split, "seq long, raw string, error string")
        head = parts.where("seq = 0").select("error").first()
        if head:
            raise SourceError(head.error)
        parts = parts.repartition(spark.sparkContext.defaultParallelism)
    got = records(parts.where("error is null").select("seq", "raw"), most_bytes)
    broken = parts.where("error is not null").select(F.col("seq").alias("line"), "error", F.lit("").alias("raw"))
    return Records(got.good, got.bad.unionAll(broken), got.lines, most_bytes, broken)


def is_stdin(path: str) -> bool:
    return path == "-"


def rereadable(path: str) -> bool:
    """A plain file or a store's address; not a pipe or the standard input."""
    return "://" in path or not (is_stdin(path) or (os.path.exists(path) and not os.path.isfile(path) and not os.path.isdir(path)))


def spooled(path: str, stream: Iterable[str] | None = None) -> str:
    """The path, or a file that holds all of the standard input, so that it can be read twice."""
    if not is_stdin(path):
        return path
    with tempfile.NamedTemporaryFile("w", suffix=".jsonl", prefix="formwright-", delete=False) as to:
        if stream is None:
            shutil.copyfileobj(sys.stdin, to)
        else:
            to.writelines(stream)
        return to.name


def read(spark: SparkSession, path: str, form: str = "jsonl", dense: bool = True) -> Records:
    if "://" not in path and not os.path.exists(path):
        raise SourceError(f"cannot open {path}")
    if not rereadable(path):
        raise SourceError(f"{path} can be read only once; give a file, or - for the standard input")
    return json_array(spark, path) if form == "json-array" else replace(records(jsonl(spark, path, dense)), path=path)


def read_text(spark: SparkSession, text: str, form: str = "jsonl") -> Records:
    return json_array(spark, text=text) if form == "json-array" else records(inline(spark, text))


def sample(of: Records, n: int) -> DataFrame:
    """The first n good records, all for 0. Of files, only as many lines are read as that takes, file by file."""
    if not n:
        return of.good
    if of.path is None:
        return of.good.orderBy("seq").limit(n)
    spark = of.good.sparkSession
    files = Files(spark)
    found: list[str] = []
    taken, good = 0, 0
    for path in sorted(p for p in files.walk(of.path, "") if not p.rsplit("/", 1)[-1].startswith(("_", "."))) if files.is_folder(of.path) else [of.path]:
        ask = 2 * (n - good) + 16
        while True:
            # the limit reads partition by partition from the first, and of a single file those are in order
            head = [r.value for r in spark.read.option("lineSep", "\n").text(path).limit(ask).collect()]
            rows = spark.createDataFrame([(taken + k, x) for k, x in enumerate(head, 1)], RAW)
            got = records(rows, of.most_bytes).good.count()
            if good + got >= n or len(head) < ask:
                break
            ask *= 4
        found += head
        taken, good = taken + len(head), good + got
        if good >= n:
            break
    rows = spark.createDataFrame(list(enumerate(found, 1)), RAW)
    return records(rows, of.most_bytes).good.orderBy("seq").limit(n)
