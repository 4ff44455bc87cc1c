"""The engine's queries over the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column as Col
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formwright.operators import changes, cost, infer
from formwright.operators import partition as P
from formwright.operators.shape import Shaped
from formwright.plans.spec import Column, Drift, Output, Spec
from formwright.session import prepared, shared_folder
from formwright.sources import lines
from formwright.sources.files import Files
from formwright.sources.lines import records
from formwright.sources.table import Table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: f(prepared(spark), sf_dir)
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A folder of its own for a query's tables, in the shared folder where the session names one."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def stamp(c: str) -> Col:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def as_json(df: DataFrame, seq: str, **fields: Col) -> DataFrame:
    """(seq, raw): JSON lines made from a table. The test tables are one file each, which one task would read and parse."""
    df = df.repartition(df.sparkSession.sparkContext.defaultParallelism)
    return df.select(F.col(seq).cast("long").alias("seq"), F.to_json(F.struct(*(c.alias(n) for n, c in fields.items()))).alias("raw"))


def orders_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return as_json(o, "o_orderkey", id=F.col("o_orderkey"), cust=F.struct(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status")), amount=F.col("o_totalprice"), day=F.date_format("o_orderdate", "yyyy-MM-dd"), at=F.concat(stamp("o_orderdate"), F.lit("Z")), priority=F.col("o_orderpriority"))


def events_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return as_json(e, "event_id", id=F.col("event_id"), ts=stamp("ts"), user=F.struct(F.col("user_id").alias("id")), type=F.col("event_type"), value=F.col("value"), tags=F.array(F.col("event_id") % 7, F.col("user_id")))


def shaped(lines_: DataFrame, *columns: Column, **more) -> Shaped:
    return Shaped(Spec("q", columns=columns, mode=more.pop("mode", "strict"), **more), records(lines_), columns)


BILLING = (Column("id", "int64", required=True), Column("status", "string", "cust.status", "lowercase"), Column("customer", "int64", "cust.key"), Column("amount_cents", "int64", "amount", "dollars_to_cents"), Column("day", "date"), Column("at", "timestamp"), Column("priority", "string", None, "uppercase"))


@query("q_shape_billing", "SELECT o_orderkey AS id, lower(o_orderstatus) AS status, o_custkey AS customer, round(o_totalprice * 100)::BIGINT AS amount_cents, o_orderdate::DATE AS day, o_orderdate AS at, upper(o_orderpriority) AS priority FROM orders")
def billing(spark, sf_dir):
    s = shaped(orders_json(spark, sf_dir), *BILLING, drift=Drift("ignore"))
    return s.table


def _columns(spark: SparkSession, cols) -> DataFrame:
    return spark.createDataFrame([(i, c.name, c.type) for i, c in enumerate(cols)], "ord int, name string, type string")


def _values(rows: str) -> str:
    return f"SELECT * FROM (VALUES {rows}) AS t(ord, name, type)"


@query("q_infer_orders", _values("(0, 'amount', 'float64'), (1, 'at', 'timestamp'), (2, 'cust.key', 'int64'), (3, 'cust.status', 'string'), (4, 'day', 'date'), (5, 'id', 'int64'), (6, 'priority', 'string')"))
def infer_orders(spark, sf_dir):
    return _columns(spark, infer.infer_columns(lines.sample(records(orders_json(spark, sf_dir)), 1000)))


@query("q_infer_events_flat", _values("(0, 'id', 'int64'), (1, 'tags', 'json'), (2, 'ts', 'string'), (3, 'type', 'string'), (4, 'user.id', 'int64'), (5, 'value', 'float64')"))
def infer_events(spark, sf_dir):
    return _columns(spark, infer.infer_columns(records(events_json(spark, sf_dir)).good))


@query("q_infer_noflatten", _values("(0, 'id', 'int64'), (1, 'tags', 'json'), (2, 'ts', 'string'), (3, 'type', 'string'), (4, 'user', 'json'), (5, 'value', 'float64')"))
def infer_whole(spark, sf_dir):
    return _columns(spark, infer.infer_columns(records(events_json(spark, sf_dir)).good, flatten=False))


def props(spark, sf_dir) -> DataFrame:
    """{"id", "p": {"k": n}, "a": [n, {"b": n}], "o": {"0": n}} from events.props."""
    k = F.get_json_object("props", "$.k").cast("long")
    return as_json(table(spark, sf_dir, "events").withColumn("k", k), "event_id", id=F.col("event_id"), p=F.struct("k"), a=F.array(F.struct(F.col("k").alias("b")), F.struct((F.col("k") + 1).alias("b"))), o=F.struct(F.col("k").alias("0")))


_K = "(props->>'$.k')::BIGINT"
for _name, _path, _type, _sql in (
    ("q_path_nested", "p.k", "int64", _K),
    ("q_path_array_index", "$.a.1.b", "int64", f"{_K} + 1"),
    ("q_path_digit_key", "o.0", "int64", _K),
    ("q_path_missing", "p.nothing.here", "int64", "NULL::BIGINT"),
    ("q_path_subtree", "p", "json", f"'{{\"k\":' || {_K} || '}}'"),
    ("q_path_whole_record", "$", "json", f"'{{\"a\":[{{\"b\":' || {_K} || '}},{{\"b\":' || ({_K} + 1) || '}}],\"id\":' || event_id || ',\"o\":{{\"0\":' || {_K} || '}},\"p\":{{\"k\":' || {_K} || '}}}}'"),
):

    @query(_name, f"SELECT event_id AS id, {_sql} AS x FROM events")
    def path(spark, sf_dir, path=_path, type_=_type):
        return shaped(props(spark, sf_dir), Column("id", "int64"), Column("x", type_, path), drift=Drift("ignore")).table


def one(field: Callable[[], Col], type_: str, transform: str | None = None, source: str = "events", seq: str = "event_id", mode: str = "infer"):
    """A query of one column over a field made from a table; a function, as columns need a session and this module must not."""

    def run(spark, sf_dir):
        df = as_json(table(spark, sf_dir, source), seq, id=F.col(seq), x=field())
        return shaped(df, Column("id", "int64"), Column("x", type_, None, transform), mode=mode, drift=Drift("ignore")).table

    return run


def _numbers(type_: str):
    """Numbers past 63 bits, negative zeros, floats and negative numbers in turn, written as they are."""

    def run(spark, sf_dir):
        big = F.lit("18446744073709550000").cast("decimal(20,0)") + F.col("user_id")
        k = F.col("event_id") % 4
        x = F.when(k == 0, big.cast("string")).when(k == 1, "-0.0").when(k == 2, (F.col("user_id") * F.lit(0.5)).cast("string")).otherwise((-F.col("user_id")).cast("string"))
        raw = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit('{"id":'), F.col("event_id"), F.lit(',"x":'), x, F.lit("}")).alias("raw"))
        return shaped(raw, Column("id", "int64"), Column("x", type_), mode="infer", drift=Drift("ignore")).table

    return run


_E, _O = "SELECT event_id AS id, {} AS x FROM events", "SELECT o_orderkey AS id, {} AS x FROM orders"
query("q_trf_lower", _E.format("lower(event_type)"))(one(lambda: F.initcap("event_type"), "string", "lowercase"))
query("q_trf_upper", _E.format("upper(event_type)"))(one(lambda: F.col("event_type"), "string", "uppercase"))
query("q_trf_trim", _E.format("event_type"))(one(lambda: F.concat(F.lit("\t  "), F.col("event_type"), F.lit(" \n　")), "string", "trim"))
query("q_trf_json_encode", _E.format("'{\"n\":' || event_id || '}'"))(one(lambda: F.struct(F.col("event_id").alias("n")), "json", "json_encode"))
query("q_trf_to_string", _E.format("user_id::VARCHAR"))(one(lambda: F.col("user_id"), "string", "to_string"))
query("q_trf_cents", _O.format("round(o_totalprice * 100)::BIGINT"))(one(lambda: F.col("o_totalprice"), "int64", "dollars_to_cents", "orders", "o_orderkey"))
query("q_trf_abs", _E.format("abs(500 - user_id)"))(one(lambda: F.lit(500) - F.col("user_id"), "int64", "abs"))
query("q_trf_empty_to_null", _E.format("CASE WHEN event_id % 2 = 0 THEN NULL ELSE event_type END"))(one(lambda: F.when(F.col("event_id") % 2 == 0, "").otherwise(F.col("event_type")), "string", "empty_to_null"))
query("q_coe_int_from_float", _E.format("CASE WHEN event_id % 2 = 0 THEN event_id ELSE NULL END"))(one(lambda: F.col("event_id") + F.when(F.col("event_id") % 2 == 0, 0.0).otherwise(0.5), "int64"))
query("q_coe_int_from_str", _E.format("CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END"))(one(lambda: F.concat(F.when(F.col("event_id") % 3 == 0, " ").otherwise("+"), F.col("user_id").cast("string")), "int64"))
query("q_coe_float_from_str", _E.format("CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id * 0.5 END::DOUBLE"))(one(lambda: F.concat((F.col("user_id") * F.lit(0.5)).cast("string"), F.when(F.col("event_id") % 3 == 0, "d").otherwise("")), "float64"))
query("q_coe_float_from_int", _E.format("user_id::DOUBLE"))(one(lambda: F.col("user_id"), "float64"))
query("q_coe_string_scalar", _E.format("CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END"))(one(lambda: F.col("user_id") % 2 == 0, "string"))
query("q_coe_bool", _E.format("user_id % 2 = 0"))(one(lambda: F.col("user_id") % 2 == 0, "bool"))
query("q_coe_bool_refused", _E.format("NULL::BOOLEAN"))(one(lambda: (F.col("user_id") % 2 == 0).cast("string"), "bool"))
query("q_coe_date_str", _E.format("CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts::DATE END"))(one(lambda: F.when(F.col("event_id") % 4 == 0, "2026-02-30").otherwise(F.date_format("ts", "yyyy-MM-dd")), "date"))
query("q_coe_date_local", _E.format("ts::DATE"))(one(lambda: F.concat(stamp("ts"), F.lit("-05:00")), "date"))
query("q_coe_date_int", _E.format("DATE '1970-01-01' + user_id::INT"))(one(lambda: F.col("user_id"), "date"))
query("q_coe_ts_str", _E.format("ts + INTERVAL 5 HOUR"))(one(lambda: F.concat(stamp("ts"), F.lit("-05:00")), "timestamp"))
query("q_coe_ts_local", _E.format("ts"))(one(lambda: stamp("ts"), "timestamp"))
query("q_coe_ts_int", _E.format("make_timestamp(user_id * 1000)"))(one(lambda: F.col("user_id"), "timestamp"))
query("q_coe_json", _E.format("'{\"a\":\"' || event_type || '\",\"b\":' || event_id || '}'"))(one(lambda: F.struct(F.col("event_id").alias("b"), F.col("event_type").alias("a")), "json"))


_BIG = "18446744073709550000 + user_id"
query("q_coe_string_numbers", _E.format(f"CASE event_id % 4 WHEN 0 THEN ({_BIG})::VARCHAR WHEN 1 THEN '-0.0' WHEN 2 THEN (user_id * 0.5)::DOUBLE::VARCHAR ELSE (-user_id)::VARCHAR END"))(_numbers("string"))
query("q_coe_json_numbers", _E.format(f"CASE event_id % 4 WHEN 0 THEN ({_BIG})::VARCHAR WHEN 1 THEN '-0.0' WHEN 2 THEN (user_id * 0.5)::DOUBLE::VARCHAR ELSE (-user_id)::VARCHAR END"))(_numbers("json"))


def flawed(spark, sf_dir) -> DataFrame:
    """Every fifth record has no id, every seventh a value that is no number."""
    e = table(spark, sf_dir, "events")
    return as_json(e, "event_id", id=F.when(F.col("event_id") % 5 != 0, F.col("event_id")), value=F.when(F.col("event_id") % 7 == 0, "n/a").otherwise((F.col("user_id") * 1).cast("string")))


FLAWED = (Column("id", "int64", required=True), Column("value", "int64"))


@query("q_required_reject", "SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END AS value FROM events WHERE event_id % 5 <> 0")
def required(spark, sf_dir):
    return shaped(flawed(spark, sf_dir), *FLAWED, mode="infer").table


@query("q_reject_sidecar", "SELECT event_id AS seq, 'required column `id` is missing or null' AS error FROM events WHERE event_id % 5 = 0")
def sidecar(spark, sf_dir):
    return shaped(flawed(spark, sf_dir), *FLAWED, mode="infer").rejects.select("seq", F.get_json_object("value", "$.error").alias("error"))


@query("q_run_report", "SELECT count(*) AS rows_in, count(*) FILTER (event_id % 5 <> 0) AS rows_out, count(*) FILTER (event_id % 5 = 0) AS rejected, 0::BIGINT AS parse_errors, count(*) FILTER (event_id % 5 <> 0 AND event_id % 7 = 0) AS drifted FROM events")
def run_report(spark, sf_dir):
    r = shaped(flawed(spark, sf_dir), *FLAWED, mode="infer").report()
    return spark.createDataFrame([(r.rows_in, r.rows_out, r.rejected, r.parse_errors, r.drift.rows_with_drift)], "rows_in long, rows_out long, rejected long, parse_errors long, drifted long")


def corrupted(spark, sf_dir) -> DataFrame:
    """Every sixth line is cut short, every tenth followed by another value, every eleventh blank."""
    k = F.col("seq")
    bad = F.when(k % 11 == 0, "  ").when(k % 6 == 0, F.expr("left(raw, length(raw) - 1)")).when(k % 10 == 0, F.concat("raw", F.lit(" 1"))).otherwise(F.col("raw"))
    return events_json(spark, sf_dir).select("seq", bad.alias("raw"))


@query("q_jsonl_bad_lines", "SELECT event_id AS seq, event_id % 11 <> 0 AND event_id % 6 <> 0 AND event_id % 10 <> 0 AS good FROM events WHERE event_id % 11 <> 0")
def bad_lines(spark, sf_dir):
    r = records(corrupted(spark, sf_dir))
    return r.good.select("seq", F.lit(True).alias("good")).unionAll(r.bad.select("line", F.lit(False)))


@query("q_oversize", "SELECT event_id AS line FROM events WHERE length('{\"id\":' || event_id || ',\"t\":\"' || event_type || '\"}') > 25")
def oversize(spark, sf_dir):
    return records(as_json(table(spark, sf_dir, "events"), "event_id", id=F.col("event_id"), t=F.col("event_type")), most_bytes=25).bad.select("line")


@query("q_jsonl_file", "SELECT row_number() OVER (ORDER BY o_orderkey) AS line, o_orderkey AS id FROM orders")
def jsonl_file(spark, sf_dir):
    path = f"{scratch(spark)}/lines"
    as_json(table(spark, sf_dir, "orders"), "o_orderkey", id=F.col("o_orderkey")).repartitionByRange(4, "seq").sortWithinPartitions("seq").select("raw").write.text(path)
    return records(lines.jsonl(spark, path)).good.select(F.col("seq").alias("line"), F.try_variant_get("v", "$.id", "bigint").alias("id"))


@query("q_json_array", "SELECT row_number() OVER (ORDER BY o_orderkey) AS index, o_orderkey AS id FROM orders")
def json_array(spark, sf_dir):
    top, files = scratch(spark), Files(spark)
    path, o = f"{top}/array.json", table(spark, sf_dir, "orders")
    j, least = as_json(o, "o_orderkey", id=F.col("o_orderkey"), s=F.lit('a,"]')), o.agg(F.min("o_orderkey")).first()[0]
    # all tasks write a part in order, and the parts are joined as they are
    j.repartitionByRange("seq").sortWithinPartitions("seq").select(F.when(F.col("seq") == least, F.col("raw")).otherwise(F.concat(F.lit(","), "raw"))).write.text(f"{top}/parts")
    files.write(f"{top}/begin", b"[\n")
    files.write(f"{top}/end", b"]\n")
    files.concatenate([f"{top}/begin", *files.walk(f"{top}/parts", ".txt"), f"{top}/end"], path)
    return lines.json_array(spark, path).good.select(F.col("seq").alias("index"), F.try_variant_get("v", "$.id", "bigint").alias("id"))


def drifting(spark, sf_dir) -> DataFrame:
    """Every third event has a currency, every fifth a nested source, every seventh an amount that is no number."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    return as_json(e, "event_id", id=k, amount=F.when(k % 7 == 0, "n/a").otherwise(F.col("user_id").cast("string")), currency=F.when(k % 3 == 0, "usd"), meta=F.when(k % 5 == 0, F.struct(F.col("user_id").alias("source"))))


DRIFTING = (Column("id", "int64"), Column("amount", "float64"))
_D = "(event_id % 3 = 0 OR event_id % 5 = 0 OR event_id % 7 = 0)"


def drifted(spark, sf_dir, policy: str) -> Shaped:
    return shaped(drifting(spark, sf_dir), *DRIFTING, mode="infer", drift=Drift(policy))


@query("q_drift_report", """
SELECT path, count(*) AS n, min(r) AS first_record, any_value(type) AS type FROM (
  SELECT row_number() OVER (ORDER BY event_id) AS r, event_id FROM events) e,
  (VALUES ('currency', 3, 'string'), ('meta.source', 5, 'int64'), ('amount', 7, 'float64')) AS p(path, k, type) WHERE event_id % k = 0 GROUP BY path""")
def drift_report(spark, sf_dir):
    d = drifted(spark, sf_dir, "warn").report().drift
    return spark.createDataFrame([(x.path, x.count, x.first_record, x.type) for m in (d.new_fields, d.type_mismatches) for x in m.values()], "path string, n long, first_record long, type string")


@query("q_drift_rescue", f"""
SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END::DOUBLE AS amount, CASE WHEN {_D} THEN '{{' || concat_ws(',',
  CASE WHEN event_id % 7 = 0 THEN '"amount":"n/a"' END, CASE WHEN event_id % 3 = 0 THEN '"currency":"usd"' END, CASE WHEN event_id % 5 = 0 THEN '"meta.source":' || user_id END) || '}}' END AS _rescued FROM events""")
def drift_rescue(spark, sf_dir):
    return drifted(spark, sf_dir, "rescue").table


@query("q_drift_quarantine", f"SELECT event_id AS id, user_id::DOUBLE AS amount FROM events WHERE NOT {_D}")
def drift_quarantine(spark, sf_dir):
    return drifted(spark, sf_dir, "quarantine").table


@query("q_drift_counts", f"SELECT count(*) AS scanned, count(*) FILTER ({_D}) AS with_drift, count(*) FILTER ({_D}) AS rescued, count(*) FILTER (event_id % 3 = 0) + count(*) FILTER (event_id % 5 = 0) + count(*) FILTER (event_id % 7 = 0) AS events FROM events")
def drift_counts(spark, sf_dir):
    d = drifted(spark, sf_dir, "rescue").report().drift
    return spark.createDataFrame([(d.scanned, d.rows_with_drift, d.rescued, d.events())], "scanned long, with_drift long, rescued long, events long")


@query("q_drift_suggest", "SELECT * FROM (VALUES ('currency', 'string'), ('meta.source', 'int64')) AS t(name, type)")
def drift_suggest(spark, sf_dir):
    return spark.createDataFrame([(c.name, c.type) for c in drifted(spark, sf_dir, "warn").report().drift.suggested_columns()], "name string, type string")


def parted(source: str, column: str, kind: str, entry: str, sql: str | None):
    def run(spark, sf_dir):
        df = table(spark, sf_dir, source)
        field = P.resolve([entry], [{"id": 1, "name": column, "type": kind}])[0]
        c = F.col(column)
        return df.groupBy(P.expression(field, c.cast("date") if kind == "date" else c).alias("part")).agg(F.count("*").alias("n"))

    query(f"q_part_{entry.split('(')[0] if '(' in entry else 'identity'}_{kind}", f"SELECT {sql} AS part, count(*) AS n FROM {source} GROUP BY 1" if sql else None)(run)


parted("events", "event_type", "string", "event_type", "event_type")
parted("events", "user_id", "long", "truncate(10, user_id)", "user_id - user_id % 10")
parted("events", "event_type", "string", "truncate(3, event_type)", "left(event_type, 3)")
parted("orders", "o_orderdate", "timestamp", "year(o_orderdate)", "(year(o_orderdate) - 1970)::INT")
parted("orders", "o_orderdate", "timestamp", "month(o_orderdate)", "((year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1)::INT")
parted("orders", "o_orderdate", "date", "day(o_orderdate)", "(o_orderdate::DATE - DATE '1970-01-01')::INT")
parted("events", "ts", "timestamp", "day(ts)", "(ts::DATE - DATE '1970-01-01')::INT")
parted("events", "ts", "timestamp", "hour(ts)", "floor(epoch_us(ts) / 3600000000)::INT")


def _murmur_sql(x: str) -> str:
    """The hash of a long as nested subqueries of unsigned arithmetic, one step each."""
    m = "4294967296::HUGEINT"
    steps = [f"SELECT {x} AS x, (({x}::HUGEINT + 18446744073709551616) % {m}) AS a, ((({x}::HUGEINT + 18446744073709551616) % 18446744073709551616) // {m}) AS b FROM events", f"SELECT x, b, (a * 3432918353) % {m} AS k FROM (%)"]

    def rotate(c: str, r: int) -> str:
        return f"(({c} * {1 << r}) % {m} + {c} // {1 << 32 - r})"

    steps.append(f"SELECT x, b, ({rotate('k', 15)} * 461845907) % {m} AS h FROM (%)")
    steps.append(f"SELECT x, ({rotate('h', 13)} * 5 + 3864292196) % {m} AS h, (b * 3432918353) % {m} AS k FROM (%)")
    steps.append(f"SELECT x, xor(h, ({rotate('k', 15)} * 461845907) % {m}) AS h FROM (%)")
    steps.append(f"SELECT x, xor(({rotate('h', 13)} * 5 + 3864292196) % {m}, 8::HUGEINT) AS h FROM (%)")
    steps.append(f"SELECT x, (xor(h, h // 65536) * 2246822507) % {m} AS h FROM (%)")
    steps.append(f"SELECT x, (xor(h, h // 8192) * 3266489909) % {m} AS h FROM (%)")
    steps.append("SELECT x, xor(h, h // 65536) AS h FROM (%)")
    out = steps[0]
    for s in steps[1:]:
        out = s.replace("(%)", f"({out})", 1) if "FROM (%)" in s else s
    return out


def _murmur_string_sql(source: str, column: str) -> str:
    """The hash of a string's bytes: four at a time in a fold over a list, then the one to three left, then the finish."""
    m = 4294967296
    rotate = lambda c, r: f"(({c} * {1 << r}) % {m} + {c} // {1 << 32 - r})"
    byte = "('0x' || substr(hex(x), 2 * ({i}) + 1, 2))::BIGINT"
    block = " + ".join(f"{byte.format(i=f'4 * b + {j}')} * {256**j}" for j in range(4))
    mixed = lambda k: f"({rotate(f'(({k}) * 3432918353 % {m})', 15)} * 461845907) % {m}"
    return f"""
SELECT n, xor(h, h // 65536) AS h FROM (SELECT n, (xor(h, h // 8192) * 3266489909) % {m} AS h FROM (
  SELECT n, (xor(h, h // 65536) * 2246822507) % {m} AS h FROM (SELECT n, xor(CASE WHEN k > 0 THEN xor(h, {mixed("k")}) ELSE h END, size) AS h FROM (
    SELECT n, size, k, list_reduce(list_prepend(0::HUGEINT, blocks), lambda h, k: ({rotate("xor(h, k)", 13)} * 5 + 3864292196) % {m}) AS h FROM (
      SELECT n, strlen(x)::HUGEINT AS size, list_transform(range(0, strlen(x) // 4), lambda b: {mixed(f"({block})::HUGEINT")}) AS blocks,
             list_sum(list_prepend(0, list_transform(range(strlen(x) // 4 * 4, strlen(x)), lambda i: {byte.format(i="i")} * (256 ** (i % 4))::BIGINT)))::HUGEINT AS k
      FROM (SELECT {column} AS x, count(*) AS n FROM {source} GROUP BY 1))))))"""


@query("q_part_bucket_string", f"SELECT ((h % 2147483648) % 8)::INT AS part, sum(n)::BIGINT AS n FROM ({_murmur_string_sql('events', 'event_type')}) GROUP BY 1")
def bucket_string(spark, sf_dir):
    field = P.resolve(["bucket(8, event_type)"], [{"id": 1, "name": "event_type", "type": "string"}])[0]
    return table(spark, sf_dir, "events").groupBy(P.expression(field, F.col("event_type")).alias("part")).agg(F.count("*").alias("n"))


@query("q_part_bucket_long", f"SELECT ((h % 2147483648) % 16)::INT AS part, count(*) AS n FROM ({_murmur_sql('user_id')}) GROUP BY 1")
def bucket_long(spark, sf_dir):
    field = P.resolve(["bucket(16, user_id)"], [{"id": 1, "name": "user_id", "type": "long"}])[0]
    return table(spark, sf_dir, "events").groupBy(P.expression(field, F.col("user_id")).alias("part")).agg(F.count("*").alias("n"))


def half(df: DataFrame, k: str, even: bool) -> DataFrame:
    return df.where((F.col(k) % 2 == 0) == even)


def orders_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("at"))


_ROWS = "o_orderkey AS id, o_orderstatus AS status, o_totalprice AS amount, o_orderdate AS at"


@query("q_ice_append", f"SELECT {_ROWS} FROM orders")
def ice_append(spark, sf_dir):
    path, o = scratch(spark), orders_rows(spark, sf_dir)
    for mode, even in (("create", True), ("append", False)):
        Table(spark, path).write(half(o, "id", even), mode, ("status",))
    return Table(spark, path).scan()


@query("q_ice_time_travel", f"SELECT {_ROWS} FROM orders WHERE o_orderkey % 2 = 0")
def ice_travel(spark, sf_dir):
    path, o = scratch(spark), orders_rows(spark, sf_dir)
    first = Table(spark, path).write(half(o, "id", True)).snapshot_id
    Table(spark, path).write(half(o, "id", False), "append")
    return Table(spark, path).scan(first)


@query("q_ice_evolve", f"SELECT {_ROWS}, CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS priority FROM orders")
def ice_evolve(spark, sf_dir):
    path, o = scratch(spark), orders_rows(spark, sf_dir)
    Table(spark, path).write(half(o, "id", True))
    more = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("priority"))
    Table(spark, path).write(half(more, "id", False), "append")
    return Table(spark, path).scan()


@query("q_ice_inspect", "SELECT count(*) AS total, 0::BIGINT AS deletes, count(*) AS live, 2 AS version FROM orders")
def ice_inspect(spark, sf_dir):
    path, o = scratch(spark), orders_rows(spark, sf_dir)
    Table(spark, path).write(half(o, "id", True))
    Table(spark, path).write(half(o, "id", False), "append")
    i = Table(spark, path).inspect()
    return spark.createDataFrame([(i["total-records"], i["total-position-deletes"], i["live-records"], i["version"])], "total long, deletes long, live long, version int")


@query("q_ice_stats", "SELECT o_orderstatus AS status, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY 1")
def ice_stats(spark, sf_dir):
    path = scratch(spark)
    Table(spark, path).write(orders_rows(spark, sf_dir), partition_by=("status",))
    t = Table(spark, path)
    rows = [(d.partition["status"], d.stats["value_counts"][1], d.stats["lower"][1], d.stats["upper"][1], d.stats["lower"][3], d.stats["upper"][3]) for d in t.live()[0]]
    df = spark.createDataFrame(rows, "status string, n long, low long, high long, least double, most double")
    return df.groupBy("status").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("least").alias("least"), F.max("most").alias("most"))


@query("q_ice_prune", f"SELECT {_ROWS} FROM orders WHERE o_orderstatus = 'F' AND o_orderkey BETWEEN 100 AND 900")
def ice_prune(spark, sf_dir):
    path = scratch(spark)
    Table(spark, path).write(orders_rows(spark, sf_dir).repartitionByRange(4, "id"), partition_by=("status",))
    return Table(spark, path).scan(prune={"status": ("F", "F"), "id": (100, 900)}).where("status = 'F' AND id BETWEEN 100 AND 900")


def upserts(spark, sf_dir) -> DataFrame:
    """Every third order again, twice, and as many new ones."""
    o = orders_rows(spark, sf_dir).where("id % 3 = 0")
    old = o.withColumn("amount", F.lit(1.0)).withColumn("__seq", F.col("id"))
    late = o.withColumn("amount", F.lit(2.0)).withColumn("__seq", F.col("id") + 10_000_000)
    new = o.withColumn("__seq", F.col("id")).withColumn("id", -F.col("id") - 1)
    return late.unionByName(old).unionByName(new)


_UPSERT = "SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN 2.0 ELSE o_totalprice END AS amount, o_orderdate AS at FROM orders UNION ALL SELECT -o_orderkey - 1, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_orderkey % 3 = 0"


def merged(spark, sf_dir, parts: tuple = (), keys: tuple = ("id",)):
    path = scratch(spark)
    Table(spark, path).write(orders_rows(spark, sf_dir), partition_by=parts)
    return path, Table(spark, path).write(upserts(spark, sf_dir), "merge", parts, keys)


@query("q_merge_upsert", _UPSERT)
def merge_upsert(spark, sf_dir):
    return Table(spark, merged(spark, sf_dir)[0]).scan()


@query("q_merge_composite", _UPSERT)
def merge_composite(spark, sf_dir):
    return Table(spark, merged(spark, sf_dir, ("status", "bucket(4, id)"), ("status", "id"))[0]).scan()


@query("q_merge_summary", "SELECT 2 * n AS distinct_keys, n AS keys_updated, n AS keys_inserted, n AS prior_rows_replaced, n AS duplicates_in_input, 0::BIGINT AS null_key_rows, 2 * n AS position_deletes FROM (SELECT count(*) AS n FROM orders WHERE o_orderkey % 3 = 0)")
def merge_summary(spark, sf_dir):
    m = merged(spark, sf_dir)[1].merge
    names = ("distinct_keys", "keys_updated", "keys_inserted", "prior_rows_replaced", "duplicates_in_input", "null_key_rows", "position_deletes")
    return spark.createDataFrame([tuple(getattr(m, n) for n in names)], ", ".join(f"{n} long" for n in names))


@query("q_merge_null_keys", "SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS id, o_orderstatus AS status, o_totalprice AS amount, o_orderdate AS at FROM orders UNION ALL SELECT NULL, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_orderkey % 2 = 1")
def merge_nulls(spark, sf_dir):
    path, o = scratch(spark), orders_rows(spark, sf_dir)
    rows = o.withColumn("id", F.when(F.col("id") % 2 == 0, F.col("id")))
    Table(spark, path).write(rows, "merge", (), ("id",))
    Table(spark, path).write(rows, "merge", (), ("id",))
    return Table(spark, path).scan()


@query("q_merge_move_partition", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'moved' ELSE o_orderstatus END AS status, o_totalprice AS amount, o_orderdate AS at FROM orders")
def merge_move(spark, sf_dir):
    path, o = scratch(spark), orders_rows(spark, sf_dir)
    Table(spark, path).write(o, partition_by=("status",))
    Table(spark, path).write(o.where("id % 3 = 0").withColumn("status", F.lit("moved")), "merge", ("status",), ("id",))
    return Table(spark, path).scan()


_LATEST = "SELECT user_id, event_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"


def log(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")


@query("q_latest_per_key", _LATEST)
def latest(spark, sf_dir):
    return changes.latest(log(spark, sf_dir), ["user_id"], ["ts", "event_id"])


@query("q_latest_by_rank", _LATEST)
def latest_by_rank(spark, sf_dir):
    return changes.latest_by_rank(log(spark, sf_dir), ["user_id"], [F.desc("ts"), F.desc("event_id")])


@query("q_cdc_current", f"SELECT * FROM ({_LATEST}) WHERE event_id % 4 <> 0")
def cdc_current(spark, sf_dir):
    return changes.current_state(log(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("event_id") % 4 == 0)


@query("q_cdc_envelope", f"SELECT user_id AS id, value AS amount FROM ({_LATEST}) WHERE event_id % 5 <> 0")
def cdc_envelope(spark, sf_dir):
    """Flat change records, shaped into a log of changes, and the current state that it tells."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    flat = as_json(e, "event_id", id=F.col("user_id"), amount=F.col("value"), __op=F.when(k % 5 == 0, "d").otherwise("u"), __deleted=(k % 5 == 0).cast("string"), __source_ts_ms=F.unix_millis(F.col("ts").cast("timestamp")), __lsn=k)
    log = shaped(flat, Column("id", "int64", required=True), Column("amount", "float64"), *changes.ENVELOPE, drift=Drift("ignore")).table
    return changes.current_of(log, ["id"])


@query("q_watermark_file", "SELECT event_id FROM events")
def watermark_file(spark, sf_dir):
    """Two pulls with a watermark kept in a file between them: each row comes once."""
    e, state = table(spark, sf_dir, "events").select("event_id"), f"{scratch(spark)}/state.json"
    first, done = changes.pull(e, "event_id", state)
    done()
    again, _ = changes.pull(e, "event_id", state)
    return first.unionAll(again)


@query("q_ice_add_files", f"SELECT {_ROWS} FROM orders")
def ice_add_files(spark, sf_dir):
    """Files that two writers made side by side, committed in one snapshot."""
    path, o = scratch(spark), orders_rows(spark, sf_dir)
    for even in (True, False):
        half(o, "id", even).write.parquet(f"{path}/data/shard-{even}")
    t = Table(spark, path)
    t.add_files(t.files.walk(f"{path}/data", ".parquet"))
    return Table(spark, path).scan()


@query("q_cdc_merge_delete", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 1 THEN 0.0 ELSE o_totalprice END AS amount FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT -o_orderkey - 1, 0.0 FROM orders WHERE o_orderkey % 5 = 1")
def cdc_merge(spark, sf_dir):
    o = orders_rows(spark, sf_dir).select("id", "amount")
    gone = o.where("id % 5 = 0").withColumn("deleted", F.lit(True))
    kept = o.where("id % 5 = 1").withColumn("amount", F.lit(0.0)).withColumn("deleted", F.lit(False))
    new = kept.withColumn("id", -F.col("id") - 1)
    never = gone.withColumn("id", -F.col("id") - 1)
    return changes.merge_changes(o, gone.unionByName(kept).unionByName(new).unionByName(never), ["id"], "deleted")


@query("q_watermark_increment", "SELECT event_id, ts FROM events WHERE event_id > 100 AND event_id <= (SELECT max(event_id) FROM events)")
def watermark(spark, sf_dir):
    return changes.increment(table(spark, sf_dir, "events").select("event_id", "ts"), "event_id", 100)[0]


@query("q_shard_union", "SELECT event_id, event_type, CASE WHEN event_id % 2 = 0 THEN value END AS value FROM events")
def shard_union(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return changes.union([half(e, "event_id", True).select("event_id", "event_type", "value"), half(e, "event_id", False).select("event_id", "event_type")])


@query("q_status_rollup", "SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def rollup(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("q_readback_total", "SELECT count(*) AS n, round(sum(round(o_totalprice * 100)::BIGINT) / 100, 2)::DOUBLE AS total FROM orders")
def readback(spark, sf_dir):
    path = scratch(spark)
    s = shaped(orders_json(spark, sf_dir), *BILLING, drift=Drift("ignore"))
    Table(spark, path).write(s.rows, schema=s.schema)
    return Table(spark, path).scan().agg(F.count("*").alias("n"), F.round(F.sum("amount_cents") / 100, 2).alias("total"))


def streamed(spark, sf_dir, **output) -> str:
    from formwright.streaming.microbatch import drain

    top = scratch(spark)
    j = events_json(spark, sf_dir)
    for part in (0, 1):
        # two files, but their lines are made by all tasks
        j.where(F.col("seq") % 2 == part).select("raw").repartition(2).write.mode("append").text(f"{top}/in")
    spec = Spec("s", mode="strict", columns=(Column("id", "int64", required=True), Column("user", "int64", "user.id"), Column("value", "float64")), output=Output("iceberg", **output), drift=Drift("ignore"))
    for _ in range(2):  # the second finds nothing new
        drain(spark, f"{top}/in", spec, f"{top}/table", f"{top}/state", files_per_batch=2)
    return f"{top}/table"


@query("q_stream_microbatch", 'SELECT event_id AS id, user_id AS "user", value FROM events')
def stream(spark, sf_dir):
    return Table(spark, streamed(spark, sf_dir)).scan()


@query("q_stream_merge", "SELECT count(*) AS n FROM (SELECT DISTINCT user_id FROM events)")
def stream_merge(spark, sf_dir):
    return Table(spark, streamed(spark, sf_dir, merge_on=("user",))).scan().agg(F.count("*").alias("n"))


@query("q_cost", "SELECT 50000000::BIGINT AS n, 37.5::DOUBLE AS vendor, 25.5::DOUBLE AS saved, 0.68::DOUBLE AS fraction")
def cost_query(spark, sf_dir):
    e = cost.estimate(50_000_000, 0.75, 12.0)
    return spark.createDataFrame([(e.rows, e.vendor, e.saved, round(e.fraction, 6))], "n long, vendor double, saved double, fraction double")


@query("q_database_export", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer WHERE c_custkey > 10 AND c_custkey <= 1000")
def export(spark, sf_dir):
    """Rows of a database table as JSON, an increment of them, shaped again."""
    part = lines.increment(table(spark, sf_dir, "customer"), "c_custkey", 10, 1000)
    return shaped(lines.rows_as_json(part, F.col("c_custkey")), Column("id", "int64", "c_custkey"), Column("name", "string", "c_name"), Column("balance", "float64", "c_acctbal"), drift=Drift("ignore")).table


@query("q_json_text", "SELECT doc_id, source FROM documents WHERE doc_id >= 0")
def json_text(spark, sf_dir):
    """Texts with any characters through JSON and back: rows whose text came through unchanged."""
    d = table(spark, sf_dir, "documents")
    s = shaped(as_json(d, "doc_id", doc_id=F.col("doc_id"), source=F.col("source"), text=F.col("text")), Column("doc_id", "int64"), Column("source"), Column("text"), drift=Drift("ignore")).table
    return s.join(d.select("doc_id", F.col("text").alias("was")), "doc_id").where(F.col("text").eqNullSafe(F.col("was"))).select("doc_id", "source")

