import random

import pytest
from llm_brute import roots

from tillroll.llm.components import components


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(1)
    n = 120
    edges = {"path": [(i, i + 1) for i in range(n - 1)], "star": [(n, i) for i in range(1, n)],
             "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(90)], "none": []}[shape]
    order = list(range(n + 1))
    rng.shuffle(order)
    edges = [(order[a], order[b]) for a, b in edges]
    nodes = {x for e in edges for x in e}
    df = spark.createDataFrame(edges + edges[:3], "a long, b long")
    assert {r.node: r.component for r in components(df, "a", "b").collect()} == roots(nodes, edges)


def test_stored_tables_are_removed(spark):
    import os

    from tillroll.llm import common

    def make():
        one = common.stored(spark.range(5), "one")
        return common.stored(one.selectExpr("id * 2 AS id"), "two")
    mark = len(common._WRITTEN)
    out = common.settled(spark, make, "result")
    assert len(common._WRITTEN) == mark + 1 and sorted(r.id for r in out.collect()) == [0, 2, 4, 6, 8]
    path = common._WRITTEN[-1].removeprefix("file:")
    assert os.path.isdir(path)
    common.release(spark, mark)
    assert len(common._WRITTEN) == mark and not os.path.isdir(path)
