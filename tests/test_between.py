import random
from collections import Counter, deque

import pytest
from codestrata.operators import between, graph


def by_hand(pairs, sources=None):
    out = {}
    for s, t in pairs:
        out.setdefault(s, set()).add(t)
    total = Counter()
    for s in out if sources is None else sources:
        hops, paths, order, queue = {s: 0}, Counter({s: 1}), [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in out.get(v, ()):
                if w not in hops:
                    hops[w] = hops[v] + 1
                    queue.append(w)
                if hops[w] == hops[v] + 1:
                    paths[w] += paths[v]
        share = Counter()
        for v in reversed(order):
            for w in out.get(v, ()):
                if hops[w] == hops[v] + 1:
                    share[v] += paths[v] / paths[w] * (1 + share[w])
            if v != s:
                total[v] += share[v]
    return {v: round(total[v], 4) for p in pairs for v in p}


@pytest.mark.parametrize("held", [True, False])
def test_betweenness_equals_counting_by_hand(spark, monkeypatch, held):
    def refused(*args):
        raise AssertionError("pairs of nodes were joined")

    if held:
        monkeypatch.setattr(graph, "shortest_path_counts", refused)
    else:
        monkeypatch.setattr(graph, "HELD", -1)
    r = random.Random(7)
    inner = {(f"v{r.randrange(14)}", f"v{r.randrange(14)}") for _ in range(24)} if held else {(f"v{i}", f"v{i % 3 + 4 * j}") for i in range(6) for j in (0, 1)}
    outer = {(f"o{r.randrange(12)}", f"v{r.randrange(18)}") for _ in range(30)} | {("o1", "alone"), ("o2", "alone"), ("o12", "v1"), ("o13", "v1")}
    pairs = {(a, b) for a, b in inner | outer if a != b}
    edges = spark.createDataFrame([(a, b) for a, b in [*pairs, ("v1", "v1"), *list(pairs)[:5]]], "source string, target string")
    for sources in [None, ["v1", "o1", "o12", "nobody"]]:
        asked = None if sources is None else spark.createDataFrame([(x,) for x in sources], "node string")
        got = {x["node"]: round(x["betweenness"], 4) for x in graph.betweenness(edges, asked).collect()}
        assert got == {**dict.fromkeys(["v1"], 0), **by_hand(pairs, sources)}


def test_starts_are_taken_in_parts(monkeypatch):
    monkeypatch.setattr(between, "CELLS", 1)
    import numpy as np
    import pyarrow as pa

    held = between.hold(np.array([10, 20, 10, 30]), np.array([20, 40, 30, 40]))
    batch = pa.RecordBatch.from_arrays([pa.array([10, None, 20]), pa.array([[], [10, 40], []], pa.list_(pa.int64())), pa.array([1, 3, 1])], ["own", "first", "times"])
    out = next(between.shares(iter([batch]), held)).to_pydict()
    assert out == {"node": [10, 20, 30], "b": [6.0, 0.5, 0.5]}
