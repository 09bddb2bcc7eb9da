import random
from datetime import datetime, timedelta

from codestrata.functions.paths import directory_key
from codestrata.operators import evaluation, governance, graph, history, parsing, resolution, retrieval
from pyspark.sql import functions as F


def edges_of(spark, pairs, kind="CALLS"):
    return spark.createDataFrame([(a, b, kind, i) for i, (a, b) in enumerate(pairs)], "source string, target string, type string, ordinal int")


def test_reach_equals_breadth_first_search(spark):
    r = random.Random(3)
    pairs = {(f"v{r.randrange(25)}", f"v{r.randrange(25)}") for _ in range(45)}
    got = {(x["node"], x["hops"]) for x in graph.reach(edges_of(spark, pairs), spark.createDataFrame([("v1",)], "node string")).collect()}
    front, seen, k = {"v1"}, {"v1": 0}, 0
    while front:
        k += 1
        front = {a for a, b in pairs if b in front} - seen.keys()
        seen |= dict.fromkeys(front, k)
    assert got == {(n, h) for n, h in seen.items() if n != "v1"}


def test_cycles_of_any_length(spark):
    ring = [f"n{i}" for i in range(7)]
    edges = edges_of(spark, [*zip(ring, ring[1:] + ring[:1]), ("n4", "n0"), ("n6", "out")])
    got = {(r["cycle"], r["length"]) for r in graph.simple_cycles(edges).collect()}
    assert got == {(" > ".join(ring), 7), (" > ".join(ring[:5]), 5)}
    assert {r["length"] for r in graph.simple_cycles(edges, 5).collect()} == {5} and graph.simple_cycles(edges.limit(0)).count() == 0


def test_betweenness_and_cycles(spark):
    b = {r["node"]: r["betweenness"] for r in graph.betweenness(edges_of(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("x", "c")])).collect()}
    assert b == {"a": 0, "b": 1, "x": 1, "c": 3, "d": 0}
    got = {(r["cycle"], r["length"]) for r in graph.simple_cycles(edges_of(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("d", "d"), ("c", "e")])).collect()}
    assert got == {("a > b", 2), ("a > b > c", 3), ("d", 1)}


def test_names_resolve_by_last_segment_then_suffix(spark):
    e = spark.createDataFrame([("m:parse", "parse", 1), ("n:parse", "parse", 2), ("m:se", "se", 3)], "uid string, name string, ordinal int")
    calls = spark.createDataFrame([("x.parse(1)",), ("reparse",), ("unknown",), (None,), ("",)], "call string")
    assert {tuple(r) for r in graph.resolve_names(calls, e).collect()} == {("x.parse(1)", "m:parse"), ("reparse", "m:parse")}


def test_directory_keys(spark):
    paths = [("./backend/ai/file.py",), ("debug_file.py",), ("scripts/x.py",), ("",), (".\\a\\b\\c.py",)]
    assert [r[0] for r in spark.createDataFrame(paths, "p string").select(directory_key("p")).collect()] == ["backend/ai", "root", "scripts", "", "a/b"]


def test_expertise_factors(spark):
    day = datetime(2024, 6, 1)
    rows = [(f"h{i}", "a@x" if i < 5 else "b@x", day - timedelta(days=i), 10, i % 2 == 0, i % 2 == 1, False, 0, "f.py") for i in range(10)]
    c = spark.createDataFrame(rows, "commit_hash string, email string, ts timestamp, lines int, is_refactor boolean, is_bug_fix boolean, is_architectural boolean, reviews int, file string")
    got = {r["email"]: r for r in history.expertise_factors(c).collect()}
    assert got["a@x"]["commit_frequency"] == 1.0 and got["a@x"]["recency"] == 1.0 and 0.9 < got["b@x"]["recency"] < 1
    assert all(0 <= got[k]["total"] <= 1 and 0 <= got[k]["confidence"] <= 1 for k in got)
    assert abs(sum(history.FACTORS.values()) - 1) < 1e-9


def test_globs_and_rules(spark):
    got = spark.createDataFrame([("backend/api/main.py",), ("api/main.py",), ("/x/backend/data/store",), ("/x/backend/data",), ("a/core/x.py",)], "p string").select(governance.layer_of(F.col("p"))).collect()
    assert [r[0] for r in got] == ["api", None, "data", None, "service"]
    i = spark.createDataFrame([("x/api/a.py", "x.data.b", 1), ("x/data/a.py", "x.api.b", 2), ("x/api/a.py", "x.core.b", 3), (".\\x\\api\\a.py", "x.data.b", 1), ("x/y.py", None, 1)], "from_path string, to_module string, line int")
    assert sorted(r["verdict"] for r in governance.validate_imports(governance.import_layers(i)).collect()) == ["ALLOW", "BLOCK", "BLOCK"]


def test_fusion_is_symmetric(spark):
    s = spark.createDataFrame([("q", "u1", 1)], "query_id string, id string, rank int")
    x = spark.createDataFrame([("q", "u1", 1), ("q", "u2", 2)], "query_id string, id string, rank int")
    a, b = ({tuple(r) for r in retrieval.fuse_rankings(*p).collect()} for p in ((s, x), (x, s)))
    assert a == b and {r[1] for r in a} == {"u1", "u2"}


def test_k_intent_grounding_packing_gate(spark):
    row = spark.range(1).select(retrieval.dynamic_k(F.lit("general"), F.lit(0.9)), retrieval.dynamic_k(F.lit("governance"), F.lit(0.8)), retrieval.dynamic_k(F.lit("general"), F.lit(0.2)), retrieval.detect_intent(F.lit("Who owns this?")), retrieval.detect_intent(F.lit(None).cast("string"))).first()
    assert tuple(row) == (4, 6, 8, "expertise", "general")
    g = retrieval.grounding(spark.createDataFrame([("1", "The parser reads files. Bananas grow tall.", "parser reads all files")], "id string, answer string, evidence string")).first()
    assert (g["sentences"], g["unsupported"], g["grounded"]) == (2, 1, False)
    packed = retrieval.pack_context(spark.createDataFrame([("q", 1, "a", "one two three"), ("q", 2, "a", "one two three"), ("q", 3, "b", "x " * 99), ("q", 4, "c", "four")], "query_id string, rank int, id string, document string"), 10)
    assert sorted(r["id"] for r in packed.collect()) == ["a", "c"]
    one = lambda f: spark.createDataFrame([(f, 0.8, 0.8, 0.8, 1.0, 1.0)], "faithfulness double, relevancy double, precision double, recall double, p95_ms double, cost double")
    assert evaluation.gate(one(0.77), one(0.80)).first()["status"] == "fail" and evaluation.gate(one(0.79), one(0.80)).first()["status"] == "pass"


def test_parsers(spark):
    rows = {r["unique_id"]: r for r in parsing.parse_python("p.py", "class A:\n    @staticmethod\n    def f(x: int = 3, *a, **k):\n        if x and a:\n            return [i for i in a if i]\n")if r["kind"] == "function"}
    f = rows["p.py:A.f"]
    assert f["is_static"] and f["cyclomatic"] == 5 and [p["name"] for p in f["parameters"]] == ["x", "a", "k"]
    java = {r["name"]: r for r in parsing.parse_braces("B.java", "class B extends C implements D {\n public int f(String s, int... n) throws E { if (n > 1 && s != null) { go(s); } return 1; }\n}\n", "java")}
    assert java["B"]["bases"] == ["C", "D"] and java["f"]["throws"] == ["E"] and java["f"]["calls"] == ["go"] and java["f"]["cyclomatic"] == 3
    rows = parsing.parse_braces("N.java", "interface N {\n int size(String s);\n class In { private static final int[] A = {1, 2}; String b, c; void go() { if (b == c) {} } abstract int later() throws E; }\n}\n", "java")
    by = {(r["kind"], r["name"]): r for r in rows}
    assert by["class", "N"]["nested_classes"] == ["In"] and by["class", "N"]["methods"] == ["size"] and by["function", "size"]["visibility"] == "public" and by["function", "size"]["cyclomatic"] == 1
    assert by["variable", "A"]["is_constant"] and by["variable", "A"]["is_static"] and by["class", "In"]["class_variables"] == ["A"] and by["function", "later"]["throws"] == ["E"] and by["function", "later"]["parent_class"] == "In"
    cpp = {(r["kind"], r["name"]): r for r in parsing.parse_braces("w.cpp", "namespace a { namespace b {\nclass W : public Z {\n int n;\npublic:\n W(int k);\n int get() const;\n};\nint W::get() const { return n; }\nstruct P { int q; };\n} }\n", "cpp")}
    assert cpp["class", "W"]["unique_id"] == "w.cpp:a::b::W" and cpp["variable", "n"]["visibility"] == "private" and cpp["function", "W"]["visibility"] == "public" and cpp["variable", "q"]["visibility"] == "public"
    py = {r["name"]: r for r in parsing.parse_python("q.py", "async def f(a, *b):\n    import os.path as p\n    for i in a:\n        await b[0](i)\n    def g(): yield 1\n    global z\n    z = 1\n\'\'\'one\ntwo\'\'\'\n") if r["kind"] in ("function", "module")}
    assert py["f"]["has_await"] and not py["f"]["is_generator"] and py["f"]["local_definitions"] == ["a", "b", "g", "i", "p"] and py["q.py"]["comment_lines"] == 2
    files = spark.createDataFrame([("x.py", "def f(:"), ("y.py", None), (None, "a"), ("z.cpp", "#include \"a.h\"\nint f() { return 1; }\n")], "path string, content string")
    got = [(r["kind"], r["file"], r["parse_success"]) for r in parsing.parse_files(files).collect()]
    assert ("module", "x.py", False) in got and ("module", "y.py", True) in got and ("import", "z.cpp", None) in got


def test_lookup(spark):
    e = spark.createDataFrame([("a/b.py:C.run", "run"), ("a/b.py:go", "go")], "uid string, name string")
    assert [r["uid"] for r in resolution.lookup(e, "a\\b.py:go").collect()] == ["a/b.py:go"] and [r["tier"] for r in resolution.lookup(e, "C.RUN").collect()] == [6]


def test_sources_and_stream(spark, tmp_path):
    import json
    import zipfile

    from codestrata.sources.files import read_archives, read_entities, read_sources, upsert, write_entities
    from codestrata.streaming.events import parse_events, windowed_activity

    (tmp_path / "src/.venv").mkdir(parents=True)
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "src/.venv/b.py").write_text("y = 1\n")
    assert [(r["path"], r["language"]) for r in read_sources(spark, str(tmp_path / "src")).collect()] == [("a.py", "python")]
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("top/a.py", "x = 1")
        z.writestr("top/note.txt", "no")
    (tmp_path / "bad.zip").write_text("no archive")
    assert [r["path"] for r in read_archives(spark, str(tmp_path / "*.zip")).collect()] == ["a.py"]
    (tmp_path / "g.json").write_text(json.dumps([{"type": "function", "name": "f", "complexity": {"cyclomatic": 2}}]))
    e = read_entities(spark, str(tmp_path / "g.json"))
    assert e.first()["complexity"]["cyclomatic"] == 2 and e.first()["visibility"] is None
    write_entities(e.union(e), str(tmp_path / "lines"), "json")
    assert read_entities(spark, str(tmp_path / "lines"), lines=True).count() == 2
    write_entities(e, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    a, b = (spark.createDataFrame(r, "k int, v string") for r in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert {tuple(r) for r in upsert(a, b, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    c = spark.createDataFrame([(2, "z", 1), (2, "b", 3), (2, "y", 2), (None, "x", 9)], "k int, v string, at int")
    assert {tuple(r)[:2] for r in upsert(a, c, ["k"], ["at"]).collect()} == {(1, "a"), (2, "b")}
    lines = spark.createDataFrame([('{"type": "edit", "ts": "2024-01-01T00:00:00"}',), ("{bad",), ('{"ts": null}',)], "value string")
    assert [r["type"] for r in parse_events(lines).collect()] == ["edit"]
    events = spark.createDataFrame([(datetime(2024, 1, 1, 1), "view", 1.0), (datetime(2024, 1, 1, 2), "view", 2.0), (datetime(2024, 1, 9), "view", 1.0)], "ts timestamp, event_type string, value double")
    events.write.parquet(str(tmp_path / "events"))
    q = windowed_activity(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))).writeStream.format("memory").queryName("activity").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["events"] for r in spark.table("activity").collect()) == [1, 2]


def test_every_core_query_runs_on_the_smallest_tables(spark, sf_dir):
    import __spark_entry__ as entry
    from codestrata.plans import registry

    assert entry.entry(spark).columns
    for name in ("g_stats", "rollup_directories", "expert_top1", "drift_report", "eval_gate", "relation_counts", "p1_variants"):
        assert registry.QUERIES[name](spark, sf_dir).count() > 0, name


def test_git_tables(spark, tmp_path):
    import os
    import subprocess

    from codestrata.sources.git import clone, git_blame, git_contents, git_files, new_path, read_git_log

    repo = str(tmp_path / "r")
    env = {**os.environ, "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null"}
    for k, who in (("AUTHOR", "a"), ("COMMITTER", "a")):
        env |= {f"GIT_{k}_NAME": who, f"GIT_{k}_EMAIL": f"{who}@x.example"}

    def git(*args, **more):
        subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True, env=env | more)

    os.mkdir(repo)
    git("init", "-b", "main")
    (tmp_path / "r/a.py").write_text("one\ntwo\nthree\nfour\n")
    git("add", ".")
    git("commit", "-m", "first", GIT_AUTHOR_DATE="2024-01-01T00:00:00Z")
    git("checkout", "-b", "side")
    (tmp_path / "r/n.txt").write_text("note\n")
    git("add", ".")
    git("commit", "-m", "side", GIT_AUTHOR_DATE="2024-01-02T00:00:00Z")
    git("checkout", "main")
    os.mkdir(f"{repo}/d")
    git("mv", "a.py", "d/a.py")
    (tmp_path / "r/d/a.py").write_text("one\nTWO\nthree\nfour\n")
    git("commit", "-am", "moved", GIT_AUTHOR_NAME="b", GIT_AUTHOR_EMAIL="b@x.example", GIT_AUTHOR_DATE="2024-01-03T00:00:00Z")
    git("merge", "--no-ff", "-m", "merge", "side")
    log = {(r["message"], r["file"], r["added"], r["deleted"]) for r in read_git_log(spark, [repo]).collect()}
    assert log == {("first", "a.py", 4, 0), ("side", "n.txt", 1, 0), ("moved", "d/a.py", 1, 1), ("merge", "n.txt", 1, 0)}
    assert {r["message"] for r in read_git_log(spark, [repo], author="b@x").collect()} == {"moved"} and read_git_log(spark, [repo], max_commits=2).select("commit_hash").distinct().count() == 2
    assert {r["file"] for r in read_git_log(spark, [repo], suffix=".py").collect()} == {"a.py", "d/a.py"}
    assert {r["file"] for r in git_files(spark, [repo]).collect()} == {"d/a.py", "n.txt"} and {r["file"] for r in git_files(spark, [repo], "side").collect()} == {"a.py", "n.txt"}
    assert [r["content"] for r in git_contents(spark, [repo], suffix=".py").collect()] == ["one\nTWO\nthree\nfour\n"]
    blame = git_blame(spark, [repo], ".py")
    assert {(r["line"], r["email"]) for r in blame.collect()} == {(1, "a@x.example"), (2, "b@x.example"), (3, "a@x.example"), (4, "a@x.example")}
    assert new_path("x/{ => y}/z.py") == "x/y/z.py" and new_path("a => b") == "b"
    assert git_files(spark, [clone(f"file://{repo}", str(tmp_path / "c"), ("file://",))]).count() == 2
    for address in (repo, "ssh://x.example/r", "--upload-pack=x"):
        try:
            clone(address, str(tmp_path / "d"))
        except ValueError:
            continue
        raise AssertionError(address)
    ranges = spark.createDataFrame([("f", "d/a.py", 1, 2), ("g", "d/a.py", 3, 900), ("none", "d/a.py", 5, 4)], "id string, file string, first int, last int")
    scores = spark.createDataFrame([("d/a.py", "a@x.example", 0.5)], "file string, email string, total double")
    assert {tuple(r) for r in history.line_experts(ranges, blame, scores).collect()} == {("f", "a@x.example", 1, 0.5), ("f", "b@x.example", 1, None), ("g", "a@x.example", 2, 0.5)}


def test_rule_files_baselines_and_events(spark, tmp_path):
    import json

    from codestrata.sources.files import drop_table, object_event, read_rules

    spec = {"layers": {"ui": {"patterns": ["**/ui/**"], "allowed_dependencies": ["db"]}, "db": {"patterns": ["**/db/**"]}}, "rules": [{"from": "db", "to": "ui", "action": "block"}], "strict_mode": True}
    (tmp_path / "r.json").write_text(json.dumps(spec))
    (tmp_path / "r.yaml").write_text("layers:\n  ui:\n    patterns: ['**/ui/**']\n    allowed_dependencies: [db]\n  db:\n    patterns: ['**/db/**']\nrules:\n  - {from: db, to: ui, action: block}\nstrict_mode: true\n")
    layers, rules, strict = read_rules(str(tmp_path / "r.json"))
    assert (layers, rules, strict) == read_rules(str(tmp_path / "r.yaml")) and strict and rules == [("db", "ui", "BLOCK")]
    i = spark.createDataFrame([("x/ui/a.py", "x.db.b", 1), ("x/db/a.py", "x.ui.b", 2), ("x/y.py", "z", 3)], "from_path string, to_module string, line int")
    checked = governance.validate_imports(governance.import_layers(i, layers=layers), rules, layers, strict)
    assert [r["verdict"] for r in checked.orderBy("line").collect()] == ["ALLOW", "BLOCK", "WARNING"]
    files = spark.createDataFrame([("x/ui/a.py",), ("x/db/a.py",), ("x/y.py",), ("x/db/b.py",)], "path string")
    shares, metrics = governance.layer_shares(files, layers=layers), governance.drift_metrics(checked)
    assert {tuple(r) for r in shares.collect()} == {("ui", 0.25), ("db", 0.5)}
    path = str(tmp_path / "baseline")
    assert governance.load_baseline(spark, path) is None and governance.drift_report(metrics, shares, None, None).first()["drift_score"] == 0
    governance.save_baseline(metrics, shares, path)
    then, then_shares = governance.load_baseline(spark, path)
    assert governance.drift_report(metrics, shares, then, then_shares).first()["balance_drift"] == 0
    other = spark.createDataFrame([("ui", 0.5), ("gone", 0.1)], "layer string, share double")
    assert governance.drift_report(metrics, shares, then, other).first()["balance_drift"] == 0.85
    assert {r["series"] for r in governance.drift_series(metrics, shares, None, None).collect()} == {"coupling", "cohesion", "ui", "db"}
    assert drop_table(spark, path) and not drop_table(spark, path)
    assert object_event({"Records": [{"s3": {"bucket": {"name": "b"}, "object": {"key": "a+b%2Fc.zip"}}}]}) == [("b", "a b/c.zip")] == object_event({"bucket": "b", "key": "a+b%2Fc.zip"})
    assert spark.createDataFrame([("a/b/c.py", "m.n", 1), ("a/b/c.py", None, 2), ("c.py", "m", 3), ("a/c.py", "m", 0)], "p string, m string, l int").select(governance.resolve_relative(F.col("p"), F.col("m"), F.col("l"))).collect() == [("a/b/m/n",), ("a",), ("m",), ("m",)]


def test_load_order_and_weights(spark):
    files = spark.createDataFrame([(f"p{i:02d}.py", "class A:\n    def m(self): pass\ndef f(): pass\n") for i in range(12)], "path string, content string")
    rows = parsing.load_order(parsing.parse_files(files).repartition(5)).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in rows] == list(range(36)) and [(r["file"], r["name"]) for r in rows[:4]] == [("p00.py", "m"), ("p00.py", "f"), ("p00.py", "A"), ("p01.py", "m")]
    for bad in ({"unknown": 0.1}, {"recency": 0.5}, {"recency": -0.1, "bug_fixes": 0.35}):
        try:
            history.checked_weights(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_blast_radius_with_all_risks(spark):
    from codestrata.operators import impact

    edges = edges_of(spark, [("a", "b"), ("test_x", "b"), ("b", "c"), ("d", "a"), ("c", "e")])
    entities = spark.createDataFrame([("b", "f.py", (10, 4)), ("c", "g.py", (1, 0)), ("z", None, None)], "uid string, file_path string, complexity struct<cyclomatic:int,cognitive:int>")
    files = spark.createDataFrame([("f.py", 0.8, 1.0)], "file string, change_risk double, bus_risk double")
    seeds = spark.createDataFrame([("b",), ("c",), ("z",)], "node string")
    got = {r["node"]: r for r in impact.impact(edges, entities, seeds, graph.betweenness(edges), files).collect()}
    b, c, z = got["b"], got["c"], got["z"]
    assert (b["blast_radius"], b["direct"], b["tests"], b["depth"]) == (3, 2, 1, 2) and b["complexity_risk"] == 0.8 and (b["change_risk"], b["bus_risk"]) == (0.8, 1.0)
    assert (c["change_risk"], c["bus_risk"]) == (0.3, 0.5) and (z["blast_radius"], z["centrality_risk"], z["change_risk"], z["bus_risk"]) == (0, 0.0, 0.0, 0.5)
    assert b["centrality_risk"] == 1.0 and abs(b["risk"] - (0.25 * 0.8 + 0.2 + 0.2 * 0.7 + 0.15 * 0.3 + 0.1 * 0.8 + 0.1)) < 1e-6 and "centrality" in b["top_risks"]
    nodes, pairs = impact.induced_subgraph(edges, seeds)
    assert {(r["node"], r["refs"]) for r in nodes.where("seed = 'b'").collect()} == {("b", 2), ("a", 1), ("d", 0), ("test_x", 0)} and pairs.where("seed = 'z'").count() == 0
