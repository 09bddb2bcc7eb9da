import random

import pytest

from codestrata.operators import hierarchy as H


def brute(rows):
    parent = {n: p if any(p == m for m, _, _ in rows) else None for n, p, _ in rows}
    name = {n: x for n, _, x in rows}
    above = {}
    for n in parent:
        seen, v = [], parent[n]
        while v is not None and v not in seen:
            seen.append(v)
            v = parent[v]
        above[n] = seen
    ring = {n for n in parent if n in above[n]}
    below = {n: sum(n in a and m != n for m, a in above.items()) for n in parent}
    out = set()
    for n in parent:
        if n in ring or ring & set(above[n]):
            out.add((n, "", -1, "", below[n], "cycle" if n in ring else "below_cycle"))
        else:
            up = [n, *above[n]]
            out.add((n, up[-1], len(up) - 1, "/".join(name[x] or "" for x in reversed(up)), below[n], "tree"))
    return out


@pytest.mark.parametrize("seed, chunk, core, stretch", [(1, 3, 2, 4), (2, 3, 2, 12), (3, 50_000, 500_000, 250_000)])
def test_random_forests_with_cycles(spark, seed, chunk, core, stretch, monkeypatch):
    monkeypatch.setattr(H, "CHUNK", chunk)
    monkeypatch.setattr(H, "BLOCK", 5)
    monkeypatch.setattr(H, "CORE", core)
    monkeypatch.setattr(H, "STRETCH", stretch)
    r = random.Random(seed)
    rows = [(f"n{i}", r.choice([None, f"n{r.randrange(60)}", f"n{r.randrange(max(1, i))}", "gone"]), r.choice(["a", "b", None])) for i in range(60)]
    got = {tuple(x) for x in H.hierarchy(spark.createDataFrame(rows, "node string, parent string, name string")).collect()}
    assert got == brute(rows)


def test_deep_chain_self_loop_and_repeats(spark):
    rows = [(f"c{i:02d}", f"c{i - 1:02d}" if i else None, str(i)) for i in range(40)] + [("s", "s", "s"), ("t", "s", "t"), ("t", "s", "t"), (None, "s", "x")]
    got = {tuple(x) for x in H.hierarchy(spark.createDataFrame(rows, "node string, parent string, name string")).collect()}
    assert got == brute([r for r in dict.fromkeys(rows) if r[0]])


def test_empty_and_flat(spark):
    schema = "node string, parent string, name string"
    assert H.hierarchy(spark.createDataFrame([], schema)).count() == 0
    assert {tuple(x) for x in H.hierarchy(spark.createDataFrame([("a", None, "A"), ("b", "zz", None)], schema)).collect()} == {("a", "a", 0, "A", 0, "tree"), ("b", "b", 0, "", 0, "tree")}


def test_class_links(spark, sf_dir):
    from codestrata.operators.class_tree import parent_links

    schema = "unique_id string, file string, entity_type string, name string, bases array<string>, parent_class string, scanned_at timestamp, ordinal bigint"
    rows = [
        ("r/a.py:A", "r/a.py", "class", "A", [None, "", "Generic[T]", "x.B [T]", "C"], None, None, 1),
        ("r/b.py:B", "r/b.py", "class", "B", None, None, None, 2),
        ("r/c.py:C", "r/c.py", "class", "C", [" mod.A"], None, None, 3),
        ("q/c.py:D", "q/c.py", "class", "D", ["B"], None, None, 4),
        ("r/a.py:A.f", "r/a.py", "function", "f", None, "A", None, 5),
        ("r/a.py:g", "r/a.py", "function", "g", None, None, None, 6),
    ]
    got = {(r["node"], r["parent"]) for r in parent_links(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("r/a.py:A", "r/b.py:B"), ("r/b.py:B", None), ("r/c.py:C", "r/a.py:A"), ("q/c.py:D", None), ("r/a.py:A.f", "r/a.py:A")}
