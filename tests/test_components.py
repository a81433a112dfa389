"""Connected components against a sequential union of sets."""

import random

import pytest

from larder.operators.components import components


def expected(edges):
    parent = {}

    def top(node):
        parent.setdefault(node, node)
        while parent[node] != node:
            node = parent[node]
        return node

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((top(a), top(b)))
            parent[b] = a
    return {node: top(node) for node in parent}


def _random(seed, nodes, n):
    rng = random.Random(seed)
    return [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)]


@pytest.mark.parametrize(
    "edges",
    [
        [],
        [(1, 2), (2, 1), (1, 2), (None, 3), (4, None), (5, 5)],
        [(i, i + 1) for i in range(60)],
        [(7, i) for i in range(40)] + [(100, 101)],
        _random(1, 80, 60),
    ],
    ids=["none", "odd rows", "chain", "hot node", "random"],
)
def test_components(spark, edges):
    found = components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert len(found) == len({row.node for row in found})
    assert {row.node: row.component for row in found} == expected(edges)


def test_rounds_leave_one_result_on_disk(spark):
    import os

    from larder import staging

    components(spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long"), "a", "b")  # makes the folder
    folder = staging._own_folder(spark)
    before = set(os.listdir(folder))
    found = components(spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long"), "a", "b")
    assert len(set(os.listdir(folder)) - before) <= 2  # the edges and the last stars
    assert {row.component for row in found.collect()} == {0}
