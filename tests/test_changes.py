"""Watermarks kept in a file, files added to a table, lines that are pushed, streams that are given."""

import json

import pytest

import formwright
from formwright.errors import EngineError
from formwright.operators.changes import pull
from formwright.sources.table import Table
from formwright.streaming.microbatch import drain


def test_pulls_go_on_from_the_file(spark, tmp_path):
    state = str(tmp_path / "state.json")
    table = lambda n: spark.range(1, n + 1).toDF("k")
    rows, commit = pull(table(5), "k", state, start=2)
    assert sorted(r.k for r in rows.collect()) == [3, 4, 5] and not (tmp_path / "state.json").exists()
    commit()
    assert json.loads((tmp_path / "state.json").read_text())["watermark"] == 5
    rows, commit = pull(table(9), "k", state)
    assert sorted(r.k for r in rows.collect()) == [6, 7, 8, 9]
    again, _ = pull(table(9), "k", state)  # the last was not committed
    assert again.count() == 4
    commit()
    empty, commit = pull(table(0), "k", state)
    commit()
    assert empty.count() == 0 and pull(table(9), "k", state)[0].count() == 0


def test_files_are_added_once(spark, tmp_path):
    for name, region in (("a", "eu"), ("b", "us")):
        spark.createDataFrame([(1, region), (2, region)], "id long, region string").coalesce(1).write.parquet(str(tmp_path / name))
    spark.createDataFrame([(1, "eu"), (2, "us")], "id long, region string").coalesce(1).write.parquet(str(tmp_path / "mixed"))
    path = lambda name: next(str(p) for p in (tmp_path / name).glob("*.parquet"))
    t = Table(spark, str(tmp_path / "t"))
    assert t.add_files([path("a")], ("region",)).rows == 2
    assert Table(spark, t.path).add_files([path("b")]).files == 1
    t = Table(spark, t.path)
    assert t.scan().count() == 4 and {d.partition["region"] for d in t.live()[0]} == {"eu", "us"} and t.version == 2
    for bad, why in ((path("a"), "already"), (path("mixed"), "several partitions")):
        with pytest.raises(EngineError, match=why):
            t.add_files([bad])


def test_lines_that_are_pushed(spark, tmp_path):
    spec = formwright.Spec("fed", mode="strict", columns=(formwright.Column("n", "int64"),), output=formwright.Output("iceberg", str(tmp_path / "t"), append=True), drift=formwright.Drift("ignore"))
    feed = formwright.Feed(spark, spec)
    assert feed.flush() is None
    feed.push('{"n":1}', {"n": 2})
    assert feed.flush().report.rows_out == 2
    feed.push({"n": 3}, "nonsense")
    assert feed.flush().report.parse_errors == 1 and sorted(r.n for r in Table(spark, str(tmp_path / "t")).scan().collect()) == [1, 2, 3]


def test_a_stream_that_is_given(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"n":1}\n{"n":2}\n')
    spec = formwright.Spec("s", mode="strict", columns=(formwright.Column("n", "int64"),), output=formwright.Output("iceberg"), drift=formwright.Drift("ignore"))
    stream = spark.readStream.text(str(tmp_path / "in")).selectExpr("value", "0 AS partition")
    drain(spark, stream, spec, str(tmp_path / "t"), str(tmp_path / "state"))
    assert Table(spark, str(tmp_path / "t")).scan().count() == 2
