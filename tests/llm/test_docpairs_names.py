import pytest

from codestrata.llm.docpairs import documented_functions, informative
from codestrata.llm.names import distance, fold, near, read_identity
from codestrata.llm import variants
from codestrata.llm.variants import edits_of, identity_pairs, link_variants, probes, same_name, segments

SAYS = ["Reads all rows and keeps the last.", "/** Never blocks. */", "TODO: tidy.\nReads all rows from disk.", ":param path: where the rows are kept on disk", "# Returns early when the disk is full."]
SAYS_NOTHING = [None, "", "  ", "***", "TODO: document", "N/A", "Load rows.", "load_rows()", "The load rows function.", "Args:\n    path:\n\nReturns:", "@param path\n@return", "See base class.", "{@inheritDoc}", "Siehe oben.", "/// Add description here.", "Parameters\n----------\npath : str", "à compléter", "Auto-generated method stub"]


@pytest.mark.parametrize("doc", SAYS)
def test_documentation_that_says_something(doc):
    assert informative(doc, "load_rows", ["path"], ["str"])


@pytest.mark.parametrize("doc", SAYS_NOTHING)
def test_documentation_that_says_nothing(doc):
    assert not informative(doc, "load_rows", ["path"], ["str"])


def test_pairs_and_declarations(spark):
    schema = "uid string, repo string, name string, parent_class string, signature string, docstring string, parameters array<struct<name:string,type_hint:string>>, return_type string, doc_source string"
    rows = [
        ("r/a.h:f", "r", "f", "C", "int f(int a)", "Counts open rows twice.", [("a", "int")], "int", "x"),
        ("r/a.cpp:f", "r", "f", "C", "int f( int a ) const", None, [("a", None)], None, None),
        ("r/b.cpp:f", "r", "f", "C", "int f(double a)", None, [None], None, None),
        ("q/a.cpp:f", "q", "f", "C", "int f(int a)", " ", None, None, None),
        ("r/a.py:g", "r", "g", None, " ", "Counts open rows.", None, None, None),
        ("r/a.py:h", "r", None, None, "def h()", "h", None, None, None),
        # The least id's docstring is trivial and hides nothing; a trivial own one is replaced.
        ("s/a.h:k", "s", "k", "C", "void k()", "TODO", None, None, None),
        ("s/b.h:k", "s", "k", "C", "void k() const", "Closes the oldest shard.", None, None, None),
        ("s/c.h:k", "s", "k", "C", "virtual void k()", "\u00a0", None, None, None),
    ]
    got = {(r["unique_id"], r["doc_source"]) for r in documented_functions(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("r/a.h:f", "own"), ("r/a.cpp:f", "declaration"), ("s/a.h:k", "declaration"), ("s/b.h:k", "own"), ("s/c.h:k", "declaration")}
    assert documented_functions(spark.createDataFrame([], schema)).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_distance_and_segments():
    import random

    r = random.Random(4)
    words = ["".join(r.choice("abc") for _ in range(r.randrange(1, 9))) for _ in range(120)]
    for a in words:
        for b in words[:40]:
            d = levenshtein(a, b)
            assert distance(a, b, 2) <= min(d, 3) and (d > 4 or distance(a, b, 2) >= min((d + 1) // 2, 3))
            for k in (2, 3):
                if d <= k and k < len(b) <= len(a):
                    index = {(i, t) for i, (_, t) in enumerate(segments(b, k))}
                    assert {(i, a[lo:hi]) for i, lo, hi in probes(a, len(b), k)} & index, (a, b)
    assert distance("deepa", "deeap", 2) == 1 and near("klitidesh", "kltiidesh") and not near("jonas", "petra")
    assert fold("PitÃ¶rane") == "pitorane" == fold("Pitörane")


FORMAL = {"abby": ("abigail",), "ted": ("edward", "theodore")}
PEOPLE = [
    ("Abigail Grosemard", "abigail.grosemard@a.example"), ("Grosemard, Abby", "agrosemard@b.example"), ("ABIGAIL GROSEMARD", None), ("Abigial Grosemard", "x@shared.example"), ("unknown", "12+agrosemard@users.noreply.example"), ("AG", "abigail.grosemard@a.example"),
    ("Petra Grosemard", "abigail.grosemard@a.example"), ("Release team, Zum Systems", "zum-release@forge.example"), ("Zum Sec.", "security@zum.example"), ("ZUM SYSTEMS Release", "release-team@zum.example"), (None, None), ("", ""),
]


def test_variants(spark):
    commits = spark.createDataFrame([(*p, 1) for p in PEOPLE + PEOPLE[:2]], "author_name string, author_email string, person int")
    given = spark.createDataFrame([("Abigail", "Abby"), (None, "x"), ("Edward", None)], "given string, short_form string")
    linked = link_variants(commits, given)
    person = {r["identity"]: r["person"] for r in linked.collect()}
    text = lambda p: f"{p[0] or ''} <{p[1] or ''}>"
    assert len({person[text(p)] for p in PEOPLE[:6]}) == 1
    assert person[text(PEOPLE[6])] not in {person[text(p)] for p in PEOPLE[:6]}
    assert person[text(PEOPLE[7])] == person[text(PEOPLE[9])] != person[text(PEOPLE[8])]
    assert " <>" not in person
    pairs = {tuple(r) for r in identity_pairs(linked).collect()}
    assert len(pairs) == 16 and all(a < b for a, b in pairs)
    assert link_variants(commits.limit(0), given.limit(0)).count() == 0


def test_readings():
    assert read_identity("Dr. Edward F. Kaposulf", "e.kaposulf@x.example", FORMAL).kind == "full"
    r = read_identity("Edward Kaposulf", "ekaposulf@x.example", FORMAL)
    assert (r.a, r.b, r.support, r.sure) == ("edward", "kaposulf", 1, "kaposulf")
    r = read_identity("Edward Kaopsulf", "edward.kaposulf@x.example", FORMAL)  # a mail only confirms
    assert (r.a, r.b, r.support) == ("edward", "kaopsulf", 0)
    assert read_identity("release-bot", "release-bot@ci.example", FORMAL).kind == "bot"
    assert read_identity("unknown", "ekaposulf@x.example", FORMAL).kind == "hint"


@pytest.mark.parametrize("heavy", [32, 0])
def test_similar_names_against_all_pairs(spark, heavy, monkeypatch):
    import random

    monkeypatch.setattr(variants, "HEAVY", heavy)
    r = random.Random(11)
    given, family = ["abigail", "petra", "li", "mueller", "oskar"], ["grosemard", "tolovung", "kim", "stabiwen"]

    def typo(w):
        i = r.randrange(len(w))
        return r.choice([w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "q" + w[i + 1 :], w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :], w.replace("ue", "u")])

    names = {tuple(sorted((typo(g) if r.random() < 0.5 else g, typo(f) if r.random() < 0.5 else f))) for _ in range(160) for g, f in [(r.choice(given), r.choice(family))]}
    names = [(p, q) for p, q in names if p and q]
    df = spark.createDataFrame([("full", f"{p} {q}", p, q) for p, q in names], "kind string, key string, p string, q string")
    got = {(x["key"], x["to"]): (x["edits"], sorted(x["changed"])) for x in variants.similar_names(df).collect()}
    want = {}
    for p, q in names:
        for x, y in names:
            swapped = " ".join((q, p))
            if (p, q) != (x, y) and (m := same_name(p, q, x, y)) and min(levenshtein(t, f"{x} {y}") for t in (f"{p} {q}", swapped)) <= min(edits_of(len(f"{p} {q}")), edits_of(len(f"{x} {y}"))):
                want[f"{p} {q}", f"{x} {y}"] = m[0]
    assert want.keys() <= got.keys() and all(same_name(*a.split(" "), *b.split(" ")) for a, b in got)
    assert all(got[k][0] == e for k, e in want.items()) and ("abigail grosemard", "grosemard petra") not in got


def test_links_are_followed_to_the_end_and_rings_closed(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(100)] + [("a", "b"), ("b", "c"), ("c", "b"), ("x", "y")]
    got = dict(map(tuple, variants._follow(spark.createDataFrame(chain, "key string, to string")).collect()))
    assert all(got[f"n{i:03d}"] == "n100" for i in range(100)) and got["a"] == got["b"] == got["c"] and got["x"] == "y"


def test_many_short_forms_and_typos_in_both_parts(spark):
    people = [("Zarobim Tolovung", "zarobim.tolovung@a.example"), ("Zarbim Tolovnug", "x@shared.example"), ("Sh7 Tolovung", "y@shared.example"), ("Short19999 Tolovung", None), ("unknown", "tolovung@b.example")]
    commits = spark.createDataFrame(people, "author_name string, author_email string")
    word = lambda i: "".join(chr(97 + int(c)) for c in f"{i:05d}")
    given = spark.createDataFrame([(f"full{word(i)}", f"zz{word(i)}") for i in range(19_998)] + [("Zarobim", "Zaro")], "given string, short_form string")
    person = {r["identity"]: r["person"] for r in link_variants(commits.union(spark.createDataFrame([("Zaro Tolovung", "z@shared.example")], commits.schema)), given).collect()}
    assert len({person[f"{n} <{m}>"] for n, m in people[:2]} | {person["Zaro Tolovung <z@shared.example>"]}) == 1
    with pytest.raises(ValueError):
        link_variants(commits, given.union(spark.createDataFrame([("a", "b"), ("c", "d")], given.schema)))
