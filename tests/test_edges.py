"""Empty tables, nulls, ties and clashing columns for the operators of the core."""

import math

from codestrata.functions import text as X
from codestrata.operators import context, governance, graph, impact, resolution, retrieval, store
from pyspark.sql import functions as F


def test_vectors_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    rows = [(i, [math.cos(i), math.sin(i)]) for i in range(40)] + [(100, None), (101, [1.0]), (102, [0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    q = v.where("vec_id < 5 OR vec_id >= 100").select(F.concat(F.lit("q"), "vec_id").alias("query_id"), "embedding")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in retrieval.vector_ranking(q, v, 3).collect()}
    for i in range(5):
        best = sorted(((-round(max(0.0, math.cos(i - j)), 6), j) for j in range(40)))[:3]
        assert {k[1]: s for k, s in got.items() if k[0] == f"q{i}"} == {j: -s for s, j in best}
    assert not any(k[0] == "q100" for k in got)
    dots = retrieval.vector_ranking(q, v, 1, metric="dot", least=0.5).collect()
    assert {r["rank"] for r in dots} == {1} and all(r["score"] >= 0.5 for r in dots)
    assert retrieval.vector_ranking(q.limit(0), v).count() == 0 and retrieval.vector_ranking(q, v.limit(0)).count() == 0


def test_search_without_anything(spark):
    corpus = spark.createDataFrame([("d1", "parse", "a/b.py", "function", "parse the file"), ("d2", None, None, "class", None)], "doc_id string, name string, file string, type string, text string")
    q = spark.createDataFrame([("q1", "parse file:a/b.py"), ("q2", None), ("q3", "class parse")], "query_id string, text string")
    vector = lambda d: d.withColumn("embedding", retrieval.hashed_vector(F.col("text")))
    ranked, trace = retrieval.hybrid(q, corpus, vector(corpus).select("doc_id", "embedding"), vector(q).select("query_id", "embedding"))
    assert {(r["query_id"], r["id"]) for r in ranked.collect()} >= {("q1", "d1")}
    assert {r["query_id"]: r["kept"] for r in trace.collect()}["q2"] == 0
    none, counts = retrieval.hybrid(q, corpus.limit(0), vector(corpus.limit(0)).select("doc_id", "embedding"), vector(q).select("query_id", "embedding"))
    assert none.count() == 0 and counts.agg(F.sum("kept")).first()[0] == 0
    made = retrieval.embed(corpus, "text", lambda texts: [[len(t)] for t in texts])
    assert [r["embedding"] for r in made.orderBy("doc_id").collect()] == [[14.0], [0.0]]
    assert retrieval.is_stale(0, 0) and retrieval.is_stale(3, 4) and not retrieval.is_stale(4, 4)


def test_graphs_without_edges(spark):
    edges = spark.createDataFrame([], "source string, target string, type string, ordinal int")
    entities = spark.createDataFrame([("a", None, None, None, None)], "uid string, file_path string, entity_type string, complexity struct<cyclomatic:int,cognitive:int>, name string")
    seeds = spark.createDataFrame([("a",), ("a",)], "node string")
    assert graph.betweenness(edges).count() == 0 and graph.reach(edges, seeds).count() == 0 and graph.simple_cycles(edges).count() == 0
    assert [r["blast_radius"] for r in impact.impact(edges, entities, seeds, graph.betweenness(edges)).collect()] == [0]
    tree = impact.impact_tree(edges, entities, seeds)
    assert tree["paths"].count() == 1 and tree["shown"].count() == 0 and impact.neighbours(edges, seeds).count() == 0
    assert graph.bounded_neighbourhood(edges, seeds).count() == 0 and graph.inheritance_chain(edges, seeds).count() == 0
    loop = spark.createDataFrame([("a", "a", "CALLS", 1)], edges.schema)
    assert graph.reach(loop, seeds).count() == 0 and impact.impact(loop, entities, seeds).first()["direct"] == 0


def test_contexts(spark):
    e = spark.createDataFrame([("f.py:a", "a", "function", "f.py", "a()", None, None, None, None, 1, False), ("f.py:B", "B", "class", "f.py", None, "Says b.\nMore.", None, ["X", None], (3, 1, 9), 2, None)],
                              "uid string, name string, entity_type string, file_path string, signature string, docstring string, parent_class string, bases array<string>, complexity struct<cyclomatic:int,cognitive:int,lines_of_code:int>, ordinal int, is_method boolean")
    edges = spark.createDataFrame([("f.py:B", "f.py:a", "CALLS", 1)], "source string, target string, type string, ordinal int")
    got = {r["node"]: r["text"] for r in context.entity_context(e, edges, spark.createDataFrame([("f.py:a",), ("f.py:B",), ("gone",)], "node string")).collect()}
    assert set(got) == {"f.py:a", "f.py:B"} and "called by (1): f.py:B" in got["f.py:a"] and "a change reaches 1 (LOW)" in got["f.py:a"] and "beside it in the file (1): f.py:B" in got["f.py:a"]
    assert "description: Says b." in got["f.py:B"] and "extends: X" in got["f.py:B"] and "More" not in got["f.py:B"]
    f = context.file_context(e).first()
    assert (f["classes"], f["functions"], f["methods"], f["max_cyclomatic"], f["most_complex"]) == (1, 1, 0, 0, "a")
    assert context.hotspots(e).count() == 0 and context.complexity_context(e).count() == 1
    scores = spark.createDataFrame([], "file string, email string, total double, commits int")
    assert context.ownership_context(scores, e.select(F.col("file_path").alias("file"))).first()["text"] == "nobody known"
    empty = spark.createDataFrame([], "from_path string, to_module string, line int")
    checked = governance.validate_imports(governance.import_layers(empty))
    assert context.governance_context(checked).count() == 0 and governance.drift_metrics(checked).first()["coupling"] == 0


def test_store(spark):
    s = store.GraphStore(spark.createDataFrame([], store.NODE), spark.createDataFrame([], store.EDGE))
    s = s.add_nodes(spark.createDataFrame([("a", {"x": "1", "y": "1"}, 1), ("a", {"x": "2"}, 2), (None, {}, 3), ("b", None, 4)], store.NODE))
    s = s.add_edges(spark.createDataFrame([("a", "c", "CALLS", None, None, 1), ("a", "c", "INHERITS", 0.5, {"k": "v"}, 2), ("a", None, "CALLS", 1.0, None, 3)], store.EDGE))
    data = {r["node"]: (r["known"], r["attributes"]) for r in s.node_data(spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "node string")).collect()}
    assert data == {"a": (True, {"x": "2", "y": "1"}), "b": (True, {}), "c": (True, {}), "d": (False, {})}
    assert [tuple(r)[2:] for r in s.edge_data(spark.createDataFrame([("a", "c"), ("c", "a")], "source string, target string")).orderBy("source").collect()] == [(True, "INHERITS", 0.5), (False, None, None)]
    assert {tuple(r) for r in s.around("c").collect()} == {("a", "in")} and s.between(type="CALLS").count() == 0 and s.cleared().all_nodes().count() == 0
    again = store.edges_from_json(store.edges_to_json(s.edges).union(spark.createDataFrame([("{bad",), ('{"source": "x", "target": "y"}',)], "value string")))
    assert {(r["source"], r["weight"]) for r in again.collect()} == {("a", 0.5), ("x", 1.0)}


def test_look_ups(spark):
    nodes = spark.createDataFrame([("m/a.py:C.run",), ("m/b.py:run",), ("x.C.run",)], "node string")
    got = {r["text"]: r["node"] for r in resolution.find_nodes(nodes, spark.createDataFrame([("run",), ("C.run",), ("m/b.py:run",), ("none",), (None,), ("",)], "text string")).collect()}
    assert got == {"run": "m/a.py:C.run", "C.run": "m/a.py:C.run", "m/b.py:run": "m/b.py:run"}
    metrics = spark.createDataFrame([("r/a/x.py", 1), ("q/x.py", 2), ("x.py", 3)], "path string, ordinal int")
    found = {r["file"]: (r["path"], r["tier"]) for r in resolution.find_metrics(metrics, spark.createDataFrame([("r/a/x.py",), ("a/x.py",), ("z/x.py",), ("none.py",)], "file string")).collect()}
    assert found == {"r/a/x.py": ("r/a/x.py", 1), "a/x.py": ("r/a/x.py", 2), "z/x.py": ("x.py", 2)}
    merged = resolution.merge_nodes(spark.createDataFrame([("a", None, 1)], "uid string, name string, degree int"), spark.createDataFrame([("a", "raw", "f.py"), ("b", "other", None)], "uid string, name string, file string"))
    assert [tuple(r) for r in merged.collect()] == [("a", "raw", 1, "f.py")]
    assert resolution.suggest(spark.createDataFrame([("m:Parse", "Parse"), ("m:x", None)], "uid string, name string"), "PARS").count() == 1


def test_text_helpers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.shorten_middle(F.lit("abcdefghij"), 6)) == "abc…ij" and one(X.shorten_end(F.lit("abc"), 3)) == "abc" and one(X.pad(F.lit(None).cast("string"), 3)) == "   "
    assert one(X.markup_to_html(F.lit("# A\n**b** <c> [d](https://e)"))) == '<h1>A</h1><br/><strong>b</strong> &lt;c&gt; <a href="https://e">d</a>'
    folder = lambda *p: X.common_folder(spark.createDataFrame([(x,) for x in p], "path string")).first()[0]
    assert folder("a/b/c.py", "a/b/d/e.py", None) == "a/b" and folder("a/b.py", "c/d.py") == "" and folder("x.py") == "" and folder("a/b.py") == "a" and folder(None) == ""
    assert X.prompt("unknown", "C", "Q").count("C") == 1 and one(X.names_in(F.lit("see `a.b` and FooBar, not Foo"))) == ["a.b", "FooBar"]


def test_tables_are_replaced_whole(spark, tmp_path):
    from codestrata.operators import evaluation
    from codestrata.sources.files import read_or_set_aside, write_atomically

    path = str(tmp_path / "t")
    assert read_or_set_aside(spark, path, "a int").count() == 0
    for n in (2, 3):
        write_atomically(spark.range(n), path)
        assert read_or_set_aside(spark, path, "id bigint").count() == n
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    (tmp_path / "b").mkdir()
    (tmp_path / "b/x.parquet").write_text("no table")
    assert read_or_set_aside(spark, str(tmp_path / "b"), "a int").count() == 0 and any(p.name.startswith("b.broken-") for p in tmp_path.iterdir())
    answers = spark.createDataFrame([("1", "q", "yes", "e"), ("2", "q", "", "e")], "id string, query string, answer string, evidence string")
    assert {tuple(r) for r in evaluation.judged(answers, lambda rows: [len(r["answer"]) for r in rows]).collect()} == {("1", 3.0), ("2", 0.0)}
