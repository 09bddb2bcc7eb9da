import json
from datetime import datetime

from codestrata.operators.records import current_records
from codestrata.operators.shred import _read_deep, child_links, read_json, shred_nodes, variant_tables

RECORD = "unique_id string, file string, scanned_at timestamp, ordinal bigint, name string, uid string"


def test_current_record_is_the_latest_of_a_compared_id(spark):
    rows = [
        ("./r/a.py:f", "./r/a.py", datetime(2024, 1, 1), 1, "old", "clash"),
        ("r\\a.py:f", "r\\a.py", datetime(2024, 1, 2), 2, "new", "clash"),
        ("r/a.py:f", "r/a.py", None, 3, "never", None),
        ("r/a.py:g", None, datetime(2024, 1, 1), 4, None, None),
        (None, "r/a.py", datetime(2024, 1, 1), 5, "nameless", None),
    ]
    out = {r["uid"]: r for r in current_records(spark.createDataFrame(rows, RECORD), ["name", "uid"]).collect()}
    assert {k: v["name"] for k, v in out.items()} == {"r/a.py:f": "new", "r/a.py:g": None}
    assert out["r/a.py:g"]["repo"] == "r" and out["r/a.py:f"]["file_path"] == "r/a.py"
    assert current_records(spark.createDataFrame([], RECORD), ["name"]).count() == 0


def links(spark, *payloads):
    df = spark.createDataFrame(list(enumerate(payloads)), "dump_id bigint, payload string").selectExpr("*", "'x' AS kind", "1 AS child")
    return {tuple(r)[1:] if len(payloads) == 1 else tuple(r) for r in child_links(variant_tables(shred_nodes(df))).collect()}


def test_nested_classes_and_methods(spark):
    inner = {"type": "class", "name": "In", "methods": [{"type": "function", "name": "m", "parameters": ["a", None, {"name": ""}, {"name": "b"}], "calls": "go", "complexity": "7"}]}
    outer = {"type": "class", "name": "Out", "unique_id": ".\\r\\f.py:Out", "nested_classes": [inner], "methods": []}
    got = links(spark, json.dumps({"file_path": "r/f.py", "classes": [outer], "functions": None}))
    assert got == {
        ("r/f.py", "entity", 0, "r/f.py:Out"), ("r/f.py:Out", "entity", 0, "r/f.py:In"), ("r/f.py:In", "entity", 0, "r/f.py:In.m"),
        ("r/f.py:In.m", "parameter", 0, "a"), ("r/f.py:In.m", "parameter", 3, "b"), ("r/f.py:In.m", "call", 0, "go"), ("r/f.py:In.m", "cyclomatic", 0, "7"),
    }


def test_maps_lists_and_several_files(spark):
    by_key = {"repo": "r", "entities": {"r/a.py:C": {"type": "class", "name": "C", "nested_classes": ["D"], "file": "r/a.py"}, "r/a.py:D": {"type": "class", "name": "D", "file": "r/a.py"}, "r/a.py:C.f": {"type": "function", "name": "f", "parent_class": "C", "file": "r/a.py", "parameters": {"x": {"type_hint": "int"}, "name": {}}, "complexity": 3.0, "calls": [{"name": "g", "line": 3}, None, {"name": None}, "h"]}}}
    assert links(spark, json.dumps(by_key)) == {
        ("r/a.py", "entity", 0, "r/a.py:C"), ("r/a.py:C", "entity", 0, "r/a.py:D"), ("r/a.py:C", "entity", 0, "r/a.py:C.f"), ("r/a.py:C.f", "parameter", 0, "x"), ("r/a.py:C.f", "parameter", 1, "name"),
        ("r/a.py:C.f", "cyclomatic", 0, "3"), ("r/a.py:C.f", "call", 0, "g"), ("r/a.py:C.f", "call", 3, "h"),
    }
    several = {"files": [{"path": "r/b.py", "entities": [{"type": "function", "name": "k", "complexity": True}]}, {"path": "r/c.py", "entities": []}]}
    assert links(spark, json.dumps(several)) == {("r/b.py", "entity", 0, "r/b.py:k")}


def test_invalid_empty_and_repeated_payloads(spark):
    one = json.dumps([{"type": "function", "name": "f", "file": "a.py"}] * 2)
    got = links(spark, one, one, '{"a": ', None, "", "[]", "3", "[NaN]", "[" * 50_000 + "]" * 50_000)
    assert got == {(0, "a.py", "entity", 0, "a.py:f"), (1, "a.py", "entity", 0, "a.py:f")}
    nodes = shred_nodes(spark.createDataFrame([(2**62 + 1, one), (2, "{"), (None, one)], "dump_id bigint, payload string"))
    tables = variant_tables(nodes)
    assert [r["dump_id"] for r in tables["functions"].collect()] == [2**62 + 1] * 2 and [r[0] for r in tables["invalid"].collect()] == [2]
    assert links(spark, "{}") == set()


def test_entities_under_any_key_and_children_by_state(spark):
    # An entity is followed wherever it is; what a parameter is called doesn't make it one.
    f = {"type": "function", "name": "f", "parameters": [{"name": "cb", "type": "function"}], "calls": {"name": "go", "signature": "go()"}, "complexity": {"cyclomatic": 2}}
    a = {"type": "class", "name": "A", "members": [f], "body": {"late": {"deep": [{"type": "function", "name": "g"}]}}}
    assert links(spark, json.dumps({"path": "r/a.py", "anything": {"goes": [a]}})) == {
        ("r/a.py", "entity", 0, "r/a.py:A"), ("r/a.py:A", "entity", 0, "r/a.py:A.f"), ("r/a.py:A", "entity", 0, "r/a.py:A.g"),
        ("r/a.py:A.f", "parameter", 0, "cb"), ("r/a.py:A.f", "call", 0, "go"), ("r/a.py:A.f", "cyclomatic", 0, "2"),
    }


def test_any_depth(spark):
    depth = 20_000
    payload = '{"a":' * depth + '[{"type": "function", "name": "f", "file": "r/a.py"}]' + "}" * depth
    assert links(spark, payload, "[" * depth, "[" * depth + "]" * (depth - 1)) == {(0, "r/a.py", "entity", 0, "r/a.py:f")}


def test_own_reader_reads_as_the_usual_one():
    good = ['{"a": [1, -2.5e3, "x\\n\\u00e9", true, false, null, {}, []], "a": {"b": ""}}', " [ ] ", "3", '"s"', '[{"k":[[]]},0]']
    assert all(_read_deep(t) == json.loads(t) == read_json(t) for t in good)
    for bad in ("", "[", "[1,]", "{,}", '{"a"}', '{"a":}', "[1 2]", "nul", "[NaN]", "01", '{"a":1,}', "[]]", '"a', "{1:2}", "-"):
        for read in (_read_deep, read_json):
            try:
                read(bad)
            except ValueError:
                continue
            raise AssertionError(bad)
