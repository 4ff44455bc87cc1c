import random

import pytest

from formwright.errors import EngineError
from formwright.operators import partition as P
from formwright.sources.table import Table

SCHEMA = "id long, region string, v long, __seq long"


def write(spark, path, rows, mode="merge", parts=(), keys=("id",)):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA)
    return Table(spark, str(path)).write(df, mode, parts, keys if mode == "merge" else ())


def rows(spark, path, snapshot=None):
    return sorted((tuple(r) for r in Table(spark, str(path)).scan(snapshot).collect()), key=str)


def test_upsert_counts(spark, tmp_path):
    write(spark, tmp_path / "t", [(1, "eu", 1), (2, "eu", 2), (3, "us", 3)])
    m = write(spark, tmp_path / "t", [(2, "eu", 20), (4, "us", 4), (4, "us", 44), (None, "eu", 9)]).merge
    assert (m.distinct_keys, m.keys_updated, m.keys_inserted, m.prior_rows_replaced, m.duplicates_in_input, m.null_key_rows, m.position_deletes, m.delete_files) == (2, 1, 1, 1, 1, 1, 2, 1)
    t = Table(spark, str(tmp_path / "t"))
    i = t.inspect()
    assert (i["total-records"], i["live-records"], t.snapshot()["summary"]["operation"]) == (7, 5, "overwrite")
    assert rows(spark, tmp_path / "t") == sorted([(1, "eu", 1), (2, "eu", 20), (3, "us", 3), (4, "us", 44), (None, "eu", 9)], key=str)
    with pytest.raises(EngineError, match="would show them again"):
        t.data_files()


def test_model_check_with_time_travel(spark, tmp_path):
    rng, model, nulls, seen = random.Random(74), {}, [], []
    for n in range(3):
        batch = [(None if rng.random() < 0.05 else rng.randrange(60), rng.choice(["eu", "us", "ap"]), rng.randrange(1000)) for _ in range(80)]
        s = write(spark, tmp_path / "m", batch, parts=("region",))
        for r in batch:
            nulls.append(r) if r[0] is None else model.__setitem__(r[0], r)
        seen.append((s.snapshot_id, sorted([*model.values(), *nulls], key=str)))
    for snapshot, expected in seen:
        assert rows(spark, tmp_path / "m", snapshot) == expected


def test_append_evolves_and_refuses(spark, tmp_path):
    path = str(tmp_path / "a")
    Table(spark, path).write(spark.createDataFrame([(1, 1.0)], "id long, amt double"))
    Table(spark, path).write(spark.createDataFrame([(2, 2.0, "eu")], "id long, amt double, region string"), "append")
    t = Table(spark, path)
    assert rows(spark, path) == [(1, 1.0, None), (2, 2.0, "eu")] and t.meta["last-column-id"] == 3 and len(t.meta["schemas"]) == 2
    for bad, words in ((("id long", [(1,)]), "dropping or renaming"), (("id long, amt string, region string", [(1, "x", "y")]), "changed type")):
        with pytest.raises(EngineError, match=words):
            Table(spark, path).write(spark.createDataFrame(bad[1], bad[0]), "append")
    for keys, words in ((("nope",), "not in the schema"), (("id", "id"), "twice"), ((), "no key column"), (("amt",), "cannot be a key")):
        with pytest.raises(EngineError, match=words):
            Table(spark, path).write(spark.createDataFrame([(1, 1.0, "x")], "id long, amt double, region string"), "merge", (), keys)
    assert Table(spark, path).version == 2


def test_pruning_moves_and_empty(spark, tmp_path):
    for batch in ([(1, "eu", 1), (2, "eu", 2)], [(100, "eu", 1), (101, "eu", 2)]):
        write(spark, tmp_path / "p", batch, "append" if batch[0][0] == 100 else "create")
    m = write(spark, tmp_path / "p", [(101, "us", 3)]).merge
    assert (m.data_files_pruned, m.prior_rows_replaced) == (Table(spark, str(tmp_path / "p")).inspect()["total-data-files"] - 1 - m.data_files_scanned, 1)
    write(spark, tmp_path / "e", [], "create")
    assert rows(spark, tmp_path / "e") == [] and Table(spark, str(tmp_path / "e")).inspect()["total-data-files"] == 1
    write(spark, tmp_path / "q", [(1, "eu", 1)], "create", ("region",))
    write(spark, tmp_path / "q", [(1, "us", 2)], "merge", ("region",))
    assert "region=eu" in Table(spark, str(tmp_path / "q")).live()[1][0].path
    (tmp_path / "q").rename(tmp_path / "moved")
    assert Table(spark, str(tmp_path / "moved")).inspect()["live-records"] == 1


def test_partition_values(spark):
    df = spark.sql("SELECT 34L AS l, timestamp_ntz'1969-12-31 23:00:00' AS t, date'2017-11-16' AS d, 'héllo world' AS s, -1L AS n")
    of = lambda e, c, kind: df.select(P.expression(P.resolve([e], [{"id": 1, "name": c, "type": kind}])[0], df[c])).first()[0]
    assert df.select(P.murmur3_long(df.l)).first()[0] == 2017239379
    assert [of(f"{k}(t)", "t", "timestamp") for k in ("year", "month", "day", "hour")] == [-1, -1, -1, -1]
    assert [of(f"{k}(d)", "d", "date") for k in ("year", "month", "day")] == [47, 47 * 12 + 10, 17486]
    assert of("truncate(4, s)", "s", "string") == "héll" and of("truncate(10, n)", "n", "long") == -10
    assert of("bucket(16, s)", "s", "string") == (P.murmur3_bytes("héllo world".encode()) & 0x7FFFFFFF) % 16


def test_two_writers_of_one_version(spark, tmp_path):
    path = str(tmp_path / "w")
    write(spark, path, [(1, "eu", 1)], "create")
    one, two = Table(spark, path), Table(spark, path)
    df = spark.createDataFrame([(2, "eu", 2)], "id long, region string, v long")
    one.write(df, "append")
    with pytest.raises(EngineError, match="another writer"):
        two.write(df, "append")
    # a writer that passed the first look finds the version made when it commits
    late = Table(spark, path)
    late.files.exists = lambda p, real=late.files.exists: False if p.endswith("v3.metadata.json") else real(p)
    Table(spark, path).write(df, "append")
    with pytest.raises(EngineError, match="another writer"):
        late.write(df, "append")
    assert rows(spark, path) == [(1, "eu", 1), (2, "eu", 2), (2, "eu", 2)]


def test_a_hot_partition_is_several_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    try:
        df = spark.range(200_000).selectExpr("id", "'eu' AS region", "hash(id) AS v")
        Table(spark, str(tmp_path / "h")).write(df.selectExpr("id", "region", "cast(v AS long) AS v"), "create", ("region",))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    t = Table(spark, str(tmp_path / "h"))
    assert len(t.live()[0]) > 1 and t.scan().count() == 200_000


def test_folder_names_keep_letters():
    field = P.resolve(["s"], [{"id": 1, "name": "s", "type": "string"}])[0]
    assert [P.path_text(field, x) for x in ("Zürich", "a b/c", "日本-1_2.3", None)] == ["Zürich", "a_b_c", "日本-1_2.3", "__NULL__"]


def test_bounds_of_text_are_hashed_not_sorted(spark, tmp_path):
    write(spark, tmp_path / "t", [(1, "eu", 1), (2, None, 2), (3, "us", 3)], "create")
    t = Table(spark, str(tmp_path / "t"))
    plan = t._bounds([d.path for d in t.live()[0]], t.fields, ["id", "region", "v"], [])._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan and "SortAggregate" not in plan
    bounds = [(d.stats["lower"].get(2), d.stats["upper"].get(2)) for d in t.live()[0] if d.records]
    assert min(b[0] for b in bounds if b[0]) == "eu" and max(b[1] for b in bounds if b[1]) == "us"


def test_many_deletes_are_several_files(spark, tmp_path, monkeypatch):
    from formwright.sources import table

    monkeypatch.setattr(table, "DELETES_PER_TASK", 20)
    write(spark, tmp_path / "t", [(i, "eu", i) for i in range(300)])
    m = write(spark, tmp_path / "t", [(i % 200, "us", 1000 + i) for i in range(400)]).merge
    assert (m.prior_rows_replaced, m.duplicates_in_input, m.position_deletes) == (200, 200, 400) and m.delete_files > 3
    for d in Table(spark, str(tmp_path / "t")).live()[1]:
        places = [(r.file_path, r.pos) for r in spark.read.parquet(d.path).collect()]
        assert places == sorted(places) and len(places) == d.records < 200
    assert rows(spark, tmp_path / "t") == sorted([(i, "us", 1200 + i) if i < 200 else (i, "eu", i) for i in range(300)], key=str)


def test_a_merge_makes_its_rows_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    def told(batches):
        for b in batches:
            with open(log, "a") as f:
                f.write("x" * b.num_rows)
            yield b

    write(spark, tmp_path / "t", [(i, "eu", i) for i in range(20)])
    dear = spark.createDataFrame([(i % 30, "us", i, i) for i in range(10, 50)], SCHEMA).mapInArrow(told, SCHEMA)
    m = Table(spark, str(tmp_path / "t")).write(dear, "merge", (), ("id",)).merge
    assert (m.distinct_keys, m.keys_updated, m.keys_inserted, m.duplicates_in_input, m.null_key_rows) == (30, 20, 10, 10, 0)
    # twice: rows with a key and rows without one are planned apart
    with open(log) as f:
        assert len(f.read()) <= 2 * 40
