import random

import pytest

from trialframe.llm.components import components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(4)
    edges = {
        "path": [(i, i + 1) for i in range(40)],
        "star": [(99, i) for i in range(60)] + [(200, 201), (-5, 200)],
        "random": [(rng.randrange(120), rng.randrange(120)) for _ in range(90)],
        "none": [],
    }[kind]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in brute([e for e in edges if e[0] != e[1]]).items()}
