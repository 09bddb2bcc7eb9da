from codestrata.operators import graph
from codestrata.session import cut


def test_edges_are_not_shuffled_for_a_small_front(spark, monkeypatch):
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().toString())
        return cut(df)

    monkeypatch.setattr(graph, "cut", noted)
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("c", "c")], "source string, target string")
    seeds = spark.createDataFrame([("b",), ("d",)], "node string")
    expected = {("b", "a", 1), ("b", "c", 2), ("b", "b", 0), ("b", "d", 3)}
    assert {tuple(r) for r in graph.reach(edges, seeds).collect()} == {x for x in expected if x[2]}
    assert len(plans) > 4 and not any("SortMergeJoin" in p for p in plans)
    monkeypatch.setattr(graph, "SMALL", 0)  # large ones are joined as they are
    assert {tuple(r) for r in graph.reach(edges, seeds).collect()} == {x for x in expected if x[2]}
