import pytest

from formwright.errors import SpecError
from formwright.operators import cost, infer
from formwright.operators import partition as P
from formwright.plans import spec as S
from formwright.sources import avro
from formwright.sources.lines import elements

BASE = "dataset: d\noutput: {format: parquet}\nschema: strict\ncolumns:\n  - {name: id, type: int64, required: true}\n"


def test_round_trip_through_yaml():
    spec = S.parse(BASE)
    assert S.parse(S.to_yaml(spec)) == spec
    assert "drift" not in S.to_yaml(spec)


@pytest.mark.parametrize(
    "text, words",
    [
        (BASE + "extra: 1\n", "unknown field `extra`"),
        (BASE.replace("dataset: d", "dataset: ' '"), "blank"),
        ("dataset: d\nschema: strict\n", "at least one column"),
        (BASE + "  - {name: id, type: string}\n", "twice"),
        (BASE + "drift: {policy: rescue, rescue_column: id}\n", "rescue column"),
        (BASE.replace("{format: parquet}", "{format: iceberg, partition_by: [x]}"), "not declared"),
        (BASE.replace("{format: parquet}", "{format: parquet, merge_on: [id]}"), "iceberg"),
        (BASE.replace("{format: parquet}", "{format: iceberg, merge_on: [id, id]}"), "twice"),
        (BASE.replace("type: int64", "type: decimal"), "unknown value"),
        ('{"dataset": 1}', "expected str"),
    ],
)
def test_refusals(text, words):
    with pytest.raises(SpecError, match=words):
        S.parse(text)


def test_effective_columns():
    spec = S.Spec("d", columns=(S.Column("b", "int64"),))
    assert [c.name for c in S.effective(spec, (S.Column("a"), S.Column("b")))] == ["b", "a"]
    with pytest.raises(SpecError):
        S.effective(S.Spec("d"))


def test_partition_expressions():
    assert P.parse(" bucket( 4 , id ) ") == P.Transform("bucket", "id", 4)
    for bad in ("bucket(id)", "bucket(0, id)", "bucket(x, id)", "day(a, b)", "md5(id)", "day(a) x", "day(a", "day((a))"):
        with pytest.raises(SpecError):
            P.parse(bad)
    assert P.split_top("region, bucket(4, id),day(ts)") == ["region", "bucket(4, id)", "day(ts)"]
    fields = [{"id": 1, "name": "d", "type": "double"}, {"id": 2, "name": "day", "type": "date"}]
    for bad in (["bucket(2, d)"], ["hour(day)"], ["nope"], ["day", "day"]):
        with pytest.raises(SpecError):
            P.resolve(bad, fields)
    assert P.murmur3_bytes(b"iceberg") == 1210000089
    day, hour = (P.Field(1000, "f", 1, "timestamp", P.Transform(k, "x")) for k in ("day", "hour"))
    assert P.path_text(day, 17486) == "2017-11-16" and P.path_text(hour, 17486 * 24 + 22) == "2017-11-16-22" and P.path_text(day, None) == "__NULL__"


def test_inference_rules():
    seen = lambda *xs: infer.decide(sum({infer.flags(x): infer.flags(x) for x in xs}.values()) if len({infer.flags(x) for x in xs}) == 1 else __import__("functools").reduce(int.__or__, map(infer.flags, xs), 0))
    assert [seen(*x) for x in ([1, 2], [1, 2.5], ["a"], ["2026-02-28"], ["2026-02-30"], ["2026-07-13T09:15:00Z"], ["2026-07-13", "2026-07-13T09:15:00Z"], [1, "a"], [[1]], [None], [True], [True, 1])] == ["int64", "float64", "string", "date", "string", "timestamp", "string", "string", "json", "string", "bool", "string"]
    assert list(infer.leaves({"b": {"d": 1, "c": {}}, "a": [1]})) == [("a", [1]), ("b.c", {}), ("b.d", 1)]


def test_array_elements():
    assert [(i, r) for i, r, e in elements('[1,"t,]wo",true,null,3.5, {"a":[1,"}"]}]')] == [(1, "1"), (2, '"t,]wo"'), (3, "true"), (4, "null"), (5, "3.5"), (6, '{"a":[1,"}"]}')]
    assert list(elements("[ ]")) == []
    for bad, index in (('[{"a":1},', 2), ("[1,]", 2), ("[1] x", 2), ("{}", 0), ("", 0), ("5", 0), ("[1}]", 1)):
        assert [i for i, _, e in elements(bad) if e] == [index]


def test_avro_round_trip():
    schema = {"type": "record", "name": "r", "fields": [{"name": "a", "type": ["null", "long"]}, {"name": "b", "type": {"type": "array", "items": "bytes"}}, {"name": "c", "type": {"type": "map", "values": "double"}}]}
    rows = [{"a": None, "b": [b"", b"x"], "c": {}}, {"a": -(1 << 62), "b": [], "c": {"k": 0.5}}]
    assert avro.read(avro.write(schema, rows))[0] == rows
    with pytest.raises(Exception, match="container"):
        avro.read(b"nope")


def test_cost():
    e = cost.estimate(50_000_000, 0.75, 12)
    assert (e.vendor, e.saved, round(e.fraction, 2)) == (37.5, 25.5, 0.68)
    assert cost.estimate(0, 0, 1).fraction is None
    assert round(cost.estimate(4, 0.75, 0.01).fraction * 100, 1) == -333233.3
