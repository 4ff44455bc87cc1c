"""Arrays in files are cut by many tasks like a text is cut by one."""

import pytest
from pyspark.sql import functions as F

from formwright.errors import SourceError
from formwright.sources import lines

TEXTS = [
    '[1, {"a": "x,]\\"[,", "b": [1, [2, {"c": "}"}]]}, "s,\\\\", null , [], "é,ü"]\n', "[]", " [ ] ", "[1]", "﻿ [1,2]", '["a,b,c,d,e,f,g,h"]', '[[[[1,2],3],4],5,{"x":{"y":[1,2]}}]',
    "[1,,2]", "[,1]", "[1,]", "[1, ]", "[1,2", "[1,", "[1,2,", "[", "[1 ", '["a,b', '[1,"a,', '[1,"a\\', "[1}", "[1,2},3]", "[{,}},1]", "[1] x", "[1],", "[1],2,[3]", "[1]]", "[1], ,", '[1,{"a":"b', "[[1,2,", "[1,[2,3],", '["\\",",2]', '[\\"a,b",1]', "[}", "[]]", "[],", "[1,2]\n\n",
]


@pytest.fixture
def split(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k) for k in names}
    yield lambda n: [spark.conf.set(k, str(n)) for k in names]
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_files_and_texts_alike(spark, tmp_path, split, block):
    split(block)
    for k, text in enumerate(TEXTS):
        (tmp_path / f"{k}.json").write_text(text, encoding="utf-8")
    got = {}
    paths = spark.read.text(str(tmp_path)).select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_name").alias("n"), F.xxhash64("_metadata.file_path").alias("f")).distinct()
    number = {r.f: int(r.n.split(".")[0]) for r in paths.collect()}
    for r in lines._array_parts(spark, str(tmp_path)).collect():
        got.setdefault(number[r.f], []).append((r.seq, r.raw, r.error))
    differ = [(text, sorted(got.get(k, []), key=str), want) for k, text in enumerate(TEXTS) if sorted(got.get(k, []), key=str) != (want := sorted(lines.elements(text), key=str))]
    assert not differ


def test_files_without_an_array_raise(spark, tmp_path):
    for text in ("", " \n", ",[1]"):
        (tmp_path / "x.json").write_text(text)
        with pytest.raises(SourceError):
            lines.json_array(spark, str(tmp_path / "x.json"))


def test_an_array_is_read_by_many_tasks(spark, tmp_path, split):
    split(100_000)
    (tmp_path / "a.json").write_text("[" + ",\n".join(f'{{"id": {i}, "s": "a,]"}}' for i in range(60_000)) + "]")
    r = lines.json_array(spark, str(tmp_path / "a.json")).lines.select("seq", F.spark_partition_id().alias("p"))
    assert tuple(r.agg(F.count("*"), F.min("seq"), F.max("seq"), F.countDistinct("seq")).first()) == (60_000, 1, 60_000, 60_000)
    assert max(x["count"] for x in r.groupBy("p").count().collect()) < 10_000
