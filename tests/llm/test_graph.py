import random

import pytest

from formwright.llm.graph import connected_components


def expected(pairs):
    root = {x: x for p in pairs if None not in p and p[0] != p[1] for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in pairs:
        if x is not None and y is not None and x != y:
            p, q = find(x), find(y)
            root[max(p, q)] = min(p, q)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("few", [0, 500_000])
def test_both_ways_give_the_same_components(spark, few):
    draw = random.Random(3)
    far = [-(1 << 63), (1 << 63) - 1, -5, 0]
    chain = [(x * 7919 % 1009, (x + 1) * 7919 % 1009) for x in range(300)]
    pairs = [*chain, *((2000 + draw.randrange(400), 2000 + draw.randrange(400)) for _ in range(150)), *zip(far, far[1:]), (5, 5), (None, 9), (9, None), (7, 7)]
    got = connected_components(spark.createDataFrame(pairs, "a long, b long"), few_edges=few)
    rows = got.collect()
    assert len(rows) == len({r.node for r in rows})
    assert {r.node: r.component for r in rows} == expected(pairs)
    assert not connected_components(spark.createDataFrame([(1, 1)], "a long, b long"), few_edges=few).count()


def test_a_small_graph_takes_few_tasks(spark):
    """A chain took over ten rounds of shuffles, each with all partitions."""
    context = spark.sparkContext
    context.setJobGroup("small graph", "")
    try:
        chain = spark.range(500).selectExpr("id AS a", "id + 1 AS b")
        assert connected_components(chain).where("component = 0").count() == 501
        tracker = context.statusTracker()
        infos = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("small graph")]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(infos) <= 12
