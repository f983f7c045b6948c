import random

import pytest

from textguard.llm import components as module
from textguard.llm.common import Scratch
from textguard.llm.components import components


def brute(edges):
    least = {k: k for e in edges for k in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    return least


@pytest.mark.parametrize("few", [1 << 20, 5])
def test_components_by_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(module, "FEW_EDGES", few)
    draw = random.Random(4)
    edges = [(draw.randrange(-40, 60), draw.randrange(-40, 60)) for _ in range(45)] + [(900, 900), (-(2**63), 2**63 - 1), (7, 8), (8, 7)]
    found = components(spark.createDataFrame(edges, "a long, b long"), Scratch("test"))
    assert {r.key: r.component for r in found.collect()} == brute(edges)
    assert components(spark.createDataFrame([], "a long, b long"), Scratch("test")).collect() == []


def test_long_paths_take_few_rounds(spark, monkeypatch):
    """Tables are written per round; with labels that walked along a path there would be hundreds."""
    monkeypatch.setattr(module, "FEW_EDGES", 20)
    stored = []

    class Counted(Scratch):
        def store(self, df, name, *folders):
            stored.append(name)
            return super().store(df, name, *folders)

    keys = random.Random(5).sample(range(10**6), 600)
    found = components(spark.createDataFrame(list(zip(keys, keys[1:], strict=False)), "a long, b long"), Counted("test"))
    assert {r.component for r in found.collect()} == {min(keys)} and found.count() == 600
    assert len(stored) < 40
