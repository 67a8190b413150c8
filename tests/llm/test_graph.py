import random

import pytest

from strandloom.llm import graph
from strandloom.llm.scratch import Scratch


def brute(edges):
    least = {x: x for e in edges for x in e}
    while True:
        before = dict(least)
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            return least


@pytest.mark.parametrize("batch", [4, 1 << 18])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_components(spark, monkeypatch, kind, batch):
    monkeypatch.setattr(graph, "BATCH", batch)
    monkeypatch.setattr(graph, "HOT_LEAST", 3)
    monkeypatch.setattr(graph, "HOT", 8)
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(400, 401 + k) for k in range(60)] + [(k, k + 1) for k in range(500, 560)] + [(460, 500), (7, 7)]
    edges = [(a, b) if kind == "long" else (f"é{a}", f"é{b}") for a, b in edges]
    rng.shuffle(edges)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, f"a {kind}, b {kind}").repartition(7), Scratch(spark, "t"), "t").collect()}
    want = brute([e for e in edges if e[0] != e[1]])
    assert got == want


def test_no_edges(spark):
    assert graph.components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long"), Scratch(spark, "t"), "t").count() == 0
