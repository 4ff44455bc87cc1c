"""The typed parse gives what the variant gives, on records of every shape."""

import random

import pytest
from pyspark.sql import functions as F

from formwright.functions import typed
from formwright.operators.shape import Shaped
from formwright.plans.spec import Column, Drift, Spec
from formwright.sources import lines

VALUES = [
    "0", "-0", "7", "-12", "9007199254740993", "9223372036854775807", "9223372036854775808", "18446744073709551615", "18446744073709551616", "-9223372036854775808",
    "0.0", "-0.0", "2.0", "2.50", "1e3", "1E-7", "5e-324", "1.7976931348623157e308", "123456789012345678.5", "true", "false", "null",
    '""', '" a "', '"7"', '"+7"', '"007"', '"2.50"', '"true"', '"null"', '"NaN"', '"Infinity"', '"-inf"', '"Ab\\u00e9\\n\\"c\\""', '"\\ud83d\\ude00"', '"[1]"', '"{}"', '"x}],\\"y\\":[1"',
    '"2026-07-13"', '"2026-02-30"', '"2026-07-13T23:30:00-05:00"', '"2026-07-13t09:15:00.123z"', '"1970-01-01T00:00:01"', '"2026-07-13T24:00:00Z"',
    "[]", "[1, 2]", '["a b", null, true]', "[1.50]", '[{"b":1,"a":2}]', "[[1],[2]]", "{}", '{"b":1,"a":[1,2]}', '{"id": 5}', '{"id":"x","new":1}',
]
LINES = [
    '{"a":1} x', '{"a":1}{"a":2}', "1],[2", '1}{"r":2', '{"a":1},{"a":2}', '{"a":1}],"y":[2', '{"a":1}],"s":1,"y":[{"a":2}', '{"a":1}]} {"r":[1', '{"a":1},', "[1]", "5", '"x"', "null", "NaN",
    "{'a':1}", "{a:1}", '{"a":NaN}', '{"a":01}', '{"a":1,"a":2}', '{"a":1,"a":"x"}', '{"a":"x","a":1}', '{"u":{"id":1},"u":{"id":2,"z":3}}', '  {"a":3}  ', '{"a":1,}', '{"a":tru}', '{"a":"\x01"}', "{", '{"a":{"a":{"a":1}}}', "", "  ",
]
COLUMNS = {
    "types": [Column("a", "int64"), Column("b", "float64"), Column("c", "string"), Column("d", "bool"), Column("e", "date"), Column("f", "timestamp"), Column("g", "json"), Column("h", "int64", "u.id")],
    "transforms": [Column("a", "int64", "a", "dollars_to_cents"), Column("b", "float64", "b", "abs"), Column("c", "string", "c", "uppercase"), Column("d", "string", "d", "empty_to_null"), Column("e", "string", "e", "json_encode"), Column("f", "string", "f", "trim"), Column("g", "json", "g", "to_string"), Column("h", "int64", "h", "abs")],
    "required": [Column("a", "int64", required=True), Column("c", "string", required=True), Column("h", "string", "u.id", "lowercase")],
}


def records(seed):
    r = random.Random(seed)
    out = list(LINES)
    for v in VALUES:
        out.append("{" + ",".join(f'"{k}":{v}' for k in "abcdefg") + f',"u":{{"id":{v}}},"h":{v}}}')
    for _ in range(250):
        keys = r.sample("abcdefghu", r.randrange(0, 9)) + r.sample(["new", "x y"], r.randrange(0, 2))
        out.append("{" + ", ".join(f'"{k}" : {r.choice(VALUES)}' if k != "u" or r.random() < 0.3 else f'"u":{{"id":{r.choice(VALUES)}}}' for k in keys) + "}")
    return out


@pytest.mark.parametrize("kind, mode, policy", [("types", "infer", "warn"), ("transforms", "infer", "rescue"), ("required", "strict", "quarantine")])
def test_same_as_by_variants(spark, monkeypatch, kind, mode, policy):
    text = [x.replace("\n", " ") for x in records(len(kind))]
    df = spark.createDataFrame(list(enumerate(text, 1)), lines.RAW)
    columns = tuple(COLUMNS[kind])
    spec = Spec("t", mode=mode, columns=columns, drift=Drift(policy))

    def result():
        s = Shaped(spec, lines.records(df), columns)
        rows = s.outcomes.select("seq", "fits", "ok", "drifted", "fatal", "reason", *(F.col(f"c{i}").cast("string") for i in range(len(columns))), "misfits", "new").collect()
        return {r.seq: str(r) for r in rows}, s.outcomes.agg(*s.counts()).first(), {r.seq: r.ok for r in rows}

    fast, counts, ok = result()
    monkeypatch.setattr(typed, "schema", lambda columns: None)
    slow, slow_counts, _ = result()
    assert {text[k - 1]: (fast[k], slow[k]) for k in slow if fast[k] != slow[k]} == {}
    assert counts == slow_counts and len(fast) == sum(bool(x.strip()) for x in text)
    good = {r.seq for r in lines.records(df).good.collect()}
    assert good == {k for k, v in ok.items() if v}
