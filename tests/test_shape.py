import datetime
import json

import pytest

from formwright.errors import DriftError, RecordError, SourceError
from formwright.operators.infer import infer_columns
from formwright.operators.run import run
from formwright.operators.shape import Shaped
from formwright.plans.spec import Column, Drift, Input, Output, Spec
from formwright.sources import lines, parquet
from formwright.sources.table import Table

# readings of weather stations: one line is no JSON, one is blank
READINGS = """{"station":"north","place":{"lat":59.5,"lon":-3},"celsius":-4.25,"seen":"2024-01-31T05:00:00+01:00","since":"1998-02-28","alerts":["ice"],"manual":false,"serial":901}
{"station":"harbour","place":{"lat":54,"lon":10.75},"celsius":6,"seen":"2024-01-31T04:10:30Z","since":"2011-12-01","alerts":[],"manual":true,"serial":77}
station;celsius
{"station":"ridge","place":{"lat":47.25},"celsius":-11.5,"seen":"2024-01-30T22:59:59Z","since":"2020-06-15","manual":true,"serial":12}

{"station":"delta","place":{"lat":-1.5,"lon":-48},"celsius":28.75,"seen":"2024-01-31T04:45:00Z","since":"2003-03-03","alerts":["heat","rain"],"manual":false,"serial":5}
{"station":"plain","place":{"lat":0,"lon":0.5},"celsius":21,"seen":"2024-01-31T00:00:00Z","since":"1975-10-10","alerts":["fog"],"manual":false,"serial":3000}
"""


def shaped(spark, text, *columns, mode="infer", **more):
    return Shaped(Spec("t", mode=mode, columns=columns, **more), lines.read_text(spark, text), columns or None)


def cells(spark, column, *values):
    text = "\n".join(json.dumps({"x": v}, ensure_ascii=False) for v in values)
    return [r[0] for r in shaped(spark, text, column, drift=Drift("ignore")).rows.orderBy("__seq").collect()]


def test_infers_and_shapes(spark):
    s = shaped(spark, READINGS)
    assert {c.name: c.type for c in s.columns} == {"station": "string", "place.lat": "float64", "place.lon": "float64", "celsius": "float64", "seen": "timestamp", "since": "date", "alerts": "json", "manual": "bool", "serial": "int64"}
    r = s.report()
    assert (r.rows_in, r.rows_out, r.rejected, r.parse_errors, r.drift.is_clean()) == (5, 5, 0, 1, True)
    assert sum(x.celsius for x in s.table.collect()) == 40.0
    assert [(b.line, b.raw) for b in s.records.bad.collect()] == [(3, "station;celsius")]
    assert "place" in {c.name for c in infer_columns(s.records.good, flatten=False)}


def test_coercions(spark):
    assert cells(spark, Column("x", "int64"), 1, 2.0, 2.5, 1e30, "7", "+7", " 7", "x", True, None, [1]) == [1, 2, None, None, 7, 7, None, None, None, None, None]
    assert cells(spark, Column("x", "float64"), 1, 0.5, "1.5", "1e3", "1.0d", True) == [1.0, 0.5, 1.5, 1000.0, None, None]
    assert cells(spark, Column("x", "bool"), True, "true", 1) == [True, None, None]
    assert cells(spark, Column("x", "string"), "a", True, 5, 2.5, 1e30, {"a": 1}) == ["a", "true", "5", "2.5", "1e+30", None]
    assert cells(spark, Column("x", "json"), "a", {"b": 1.0, "a": [1, None]}, 3) == ["a", '{"a":[1,null],"b":1.0}', "3"]
    d = datetime.date
    assert cells(spark, Column("x", "date"), "2026-02-28", "2026-02-30", "2026-07-13T23:30:00-05:00", 1, 1.5, "2026") == [d(2026, 2, 28), None, d(2026, 7, 13), d(1970, 1, 2), None, None]
    t = datetime.datetime
    assert cells(spark, Column("x", "timestamp"), "2026-07-13T23:30:00-05:00", "1970-01-01T00:00:01", 1000, "2026-07-13") == [t(2026, 7, 14, 4, 30), t(1970, 1, 1, 0, 0, 1), t(1970, 1, 1, 0, 0, 1), None]


def test_transforms(spark):
    of = lambda name, kind, *v: cells(spark, Column("x", kind, None, name), *v)
    assert of("uppercase", "string", "hi", "ß", 5) == ["HI", "SS", "5"]
    assert of("trim", "string", "\t x　\n") == ["x"]
    assert of("dollars_to_cents", "int64", 12.5, 3, 99.99, 0, -0.125, "12.5") == [1250, 300, 9999, 0, -13, None]
    assert of("abs", "int64", -3, 3) == [3, 3]
    assert of("abs", "float64", -(2**63), -1.5) == [2.0**63, 1.5]
    assert of("empty_to_null", "string", "", " ") == [None, " "]
    assert of("json_encode", "string", {"a": 1}, "s", 2) == ['{"a":1}', "s", "2"]
    assert of("to_string", "string", [1], None) == ["[1]", None]


def test_paths(spark):
    r = lambda path, kind="json": cells(spark, Column("x", kind, path), {"b": [10, 20], "0": "key", 'q"': 1})[0]
    assert [r("x.b.1"), r("$.x.b.0"), r("x.missing"), r("x.0"), r('x.q"')] == ["20", "10", None, "key", "1"]
    assert json.loads(r("$")) == {"x": {"b": [10, 20], "0": "key", 'q"': 1}}


def test_malformed_lines_are_found(spark):
    text = '{"a":1} x\n{"a":1}{"a":2}\n1],[2\n1}{"r":2\n{"a":1,"a":2}\nNaN\n  {"a":3}  \n[1'
    r = lines.read_text(spark, text)
    assert [x.seq for x in r.good.orderBy("seq").collect()] == [5, 7]
    assert [x.line for x in r.bad.orderBy("line").collect()] == [1, 2, 3, 4, 6, 8]
    assert lines.records(lines.inline(spark, '{"a":1}\n"aaaaaaaaaaaaaaaaaaaaaaaaa"\n2'), 16).bad.count() == 1
    assert lines.read_text(spark, "[1, {}]", "json-array").good.count() == 2
    with pytest.raises(SourceError):
        lines.read_text(spark, "{}", "json-array")


SHIFTED = """{"celsius":1,"station":"a"}
{"celsius":"frozen","station":"b","wind":{"gust":40},"battery":null}
{"celsius":-2,"station":"c","humidity":0.5}
{"celsius":3.5,"station":"d"}
{"celsius":4,"station":"e","humidity":1,"wind":{"gust":12}}
"""
STATION = (Column("station"), Column("celsius", "float64"))


def test_drift_policies(spark):
    of = lambda p: shaped(spark, SHIFTED, *STATION, drift=Drift(p))
    d = of("warn").report().drift
    assert (d.scanned, d.rows_with_drift, d.events()) == (5, 3, 5)
    assert {p: (x.count, x.first_record, x.type) for p, x in d.new_fields.items()} == {"humidity": (2, 3, "float64"), "wind.gust": (2, 2, "int64")}
    assert [(p, x.count, x.first_record, x.examples) for p, x in d.type_mismatches.items()] == [("celsius", 1, 2, ['"frozen"'])]
    assert of("ignore").report().drift.is_clean()
    kept = {r.station: json.loads(r._rescued) if r._rescued else None for r in of("rescue").table.collect()}
    assert kept == {"a": None, "b": {"celsius": "frozen", "wind.gust": 40}, "c": {"humidity": 0.5}, "d": None, "e": {"humidity": 1, "wind.gust": 12}}
    q = of("quarantine")
    assert sorted(r.station for r in q.table.collect()) == ["a", "d"] and q.report().drift.quarantined == 3
    assert sum("humidity" in r.value for r in q.rejects.collect()) == 2
    with pytest.raises(DriftError, match="record 2.*wind.gust"):
        of("error").check()


def test_covered_paths_are_clean(spark):
    text = '{"user":{"a":1},"tags":[1],"extra":null}'
    assert shaped(spark, text, Column("user", "json"), Column("t", "int64", "tags.0")).report().drift.is_clean()
    assert shaped(spark, '{"a":{"b":1,"c":2}}', Column("b", "int64", "a.b")).report().drift.new_fields.keys() == {"a.c"}
    assert shaped(spark, '{"a":1}', Column("all", "json", "$")).report().drift.is_clean()


def test_required_and_strict(spark):
    need = Column("id", "int64", required=True)
    s = shaped(spark, '{"id":1}\n{"nope":1}\n{"id":"x"}', need)
    assert s.table.count() == 1 and s.report().rejected == 2
    with pytest.raises(RecordError, match="record 2"):
        shaped(spark, '{"id":1}\n{"nope":1}', need, mode="strict").check()
    with pytest.raises(RecordError, match="record 1"):
        shaped(spark, '{"n":"x"}', Column("n", "int64"), mode="strict").check()


def test_run_writes_sidecars_and_nothing_on_abort(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text(READINGS)
    spec = Spec("weather", input=Input(path=str(tmp_path / "in.jsonl")), output=Output(path=f"{tmp_path}/out/"))
    r = run(spark, spec)
    assert r.path.endswith("/out/weather.parquet") and parquet.inspect(spark, r.path)["rows"] == 5
    assert json.loads((tmp_path / "out" / ".rejects.jsonl").read_text()) == {"line": 3, "error": "not a valid JSON value", "raw": "station;celsius"}
    strict = spec.replace(mode="strict", columns=(Column("station"),), output=Output("iceberg", f"{tmp_path}/t"), drift=Drift("error"))
    with pytest.raises(DriftError):
        run(spark, strict)
    assert Table(spark, f"{tmp_path}/t").meta is None and (tmp_path / "t.drift.json").exists() and not list((tmp_path / "t").rglob("*.parquet"))


def test_one_file_of_many_tasks(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text("".join(f'{{"n":{k},"x":{k}.5{"x" if k == 7777 else ""}}}\n' for k in range(20_000)))
    spec = Spec("n", mode="strict", columns=(Column("n", "int64", required=True), Column("x", "float64")), input=Input(path=str(tmp_path / "in.jsonl")), output=Output(path=f"{tmp_path}/n.parquet"), row_group_rows=3000, drift=Drift("ignore"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        r = run(spark, spec)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    seen = parquet.inspect(spark, r.path)
    assert (r.report.rows_in, r.report.parse_errors, seen["rows"], r.row_groups) == (19_999, 1, 19_999, seen["row_groups"]) and r.row_groups >= 7
    assert [x.n for x in spark.read.parquet(r.path).collect()] == [k for k in range(20_000) if k != 7777]
    assert json.loads((tmp_path / "n.parquet.rejects.jsonl").read_text())["line"] == 7778
    # rejects that cannot be written leave the old file as it was
    (tmp_path / "n.parquet.rejects.jsonl").unlink()
    (tmp_path / "n.parquet.rejects.jsonl.part").mkdir()
    (tmp_path / "n.parquet.rejects.jsonl.part" / "x").write_text("in the way")
    before = (tmp_path / "n.parquet").read_bytes()
    with pytest.raises(Exception):
        run(spark, spec.replace(columns=(Column("n", "int64"),)))
    assert (tmp_path / "n.parquet").read_bytes() == before and not list(tmp_path.glob("*staging*"))


def test_sample_reads_the_first_lines_alone(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.jsonl").write_text("not json\n" + "".join(f'{{"n":{i * 1000 + j}}}\n' for j in range(1000)))
    records = lines.read(spark, str(tmp_path))
    for n in (5, 1000, 1500, 9000):
        got = lines.sample(records, n).selectExpr("seq", "try_variant_get(v, '$.n', 'bigint') AS n").orderBy("seq").collect()
        assert [r.n for r in got] == list(range(min(n, 3000))) and [r.seq for r in got][:3] == [2, 3, 4]


def test_line_numbers_over_several_blocks(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.jsonl").write_text("".join(f'{{"n":{i * 1000 + j}}}\n' for j in range(1000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = lines.records(lines.jsonl(spark, str(tmp_path))).good.selectExpr("seq", "try_variant_get(v, '$.n', 'bigint') AS n").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.seq, r.n) for r in got) == [(i + 1, i) for i in range(3000)]


@pytest.mark.parametrize("kind", ["string", "json"])
def test_whole_numbers_past_64_bits_keep_their_digits(spark, kind):
    written = ["9223372036854775808", "9999999999999999999", "18446744073709551615", "18446744073709551616", "18446744073709559000", "-9223372036854775809", "9" * 38]
    other = {"18446744073709551700.0": "1.8446744073709552e+19", "1e20": "1e+20", "1" + "0" * 38: "1e+38", "-0.0": "-0.0"}
    text = "\n".join(f'{{"x":{x}}}' for x in [*written, *other])
    assert [r.x for r in shaped(spark, text, Column("x", kind), drift=Drift("ignore")).rows.orderBy("__seq").collect()] == [*written, *other.values()]
    if kind == "json":
        nested = "\n".join(f'{{"x":[{x}]}}' for x in [*written, "1" + "0" * 400])
        assert [r.x for r in shaped(spark, nested, Column("x", kind), drift=Drift("ignore")).rows.orderBy("__seq").collect()] == [f"[{x}]" for x in [*written, "null"]]


def test_a_drift_report_counts_paths_in_one_pass(spark, monkeypatch):
    from formwright.operators import drift

    calls, count = [], drift.path_counts
    monkeypatch.setattr(drift, "path_counts", lambda *a: calls.append(a) or count(*a))
    monkeypatch.setattr(drift, "MOST_PATHS", 2)
    text = "\n".join(json.dumps({"n": "x" if k % 2 else k, f"new{k % 4}": k}) for k in range(12))
    d = shaped(spark, text, Column("n", "int64")).report().drift
    assert len(calls) == 1 and d.truncated and sorted(d.new_fields) == ["new0", "new1"]
    assert (d.new_fields["new1"].count, d.new_fields["new1"].first_record, d.type_mismatches["n"].count, d.type_mismatches["n"].first_record) == (3, 2, 6, 2)
