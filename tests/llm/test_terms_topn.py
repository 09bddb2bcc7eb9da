import random
from collections import Counter

import pytest

from codestrata.llm.record_queries import call_term
from codestrata.llm.terms import term_frequencies
from codestrata.llm.topn import top_n_per_group
from pyspark.sql import functions as F


def test_terms_against_counting(spark):
    r = random.Random(1)
    rows = [(f"r{r.randrange(200)}", "hot" if r.random() < 0.4 else f"t{int(r.paretovariate(0.7)) % 400}") for _ in range(5000)] + [(None, "x"), ("r1", None), ("r1", "")]
    got = {x["term"]: (x["occurrences"], x["records"], x["mark"]) for x in term_frequencies(spark.createDataFrame(rows, "record string, term string").withColumn("mark", F.lit(1)), "record", "term", 2, 0.05).collect()}
    kept = [(a, b) for a, b in rows if a is not None and b is not None]
    occ, rec, n = Counter(b for _, b in kept), Counter(b for _, b in set(kept)), len({a for a, _ in kept})
    assert got == {t: (occ[t], rec[t], "rare" if rec[t] <= 2 else "common" if rec[t] > n * 0.05 else "useful") for t in occ}
    assert term_frequencies(spark.createDataFrame([], "record string, term string"), "record", "term").count() == 0


def test_call_terms(spark):
    calls = [(" a.b() ",), ("f ()",), ("g()()",), ("\th\t",), ("()",), (None,), ("x( )",)]
    assert [r[0] for r in spark.createDataFrame(calls, "c string").select(call_term(F.col("c"))).collect()] == ["a.b", "f", "g()", "h", "", None, "x( )"]


@pytest.mark.parametrize("partitions", [1, 7])
def test_top_n_against_sorting(spark, partitions):
    r = random.Random(2)
    rows = [(r.choice(["hot", "hot", "a", "b", None, f"g{r.randrange(50)}"]), r.choice([None, 1, 1, 2, 3]), f"id{r.randrange(3000)}", "place") for _ in range(4000)]
    df = spark.createDataFrame(rows, "g string, score int, id string, place string").withColumn("_g", F.lit("kept")).repartition(partitions)
    got = sorted(((x["g"] or "", x["place"], x["score"], x["id"]) for x in top_n_per_group(df, ["g"], "score", ["id"], 3).collect()))
    want = []
    for g in {x[0] for x in rows}:
        best = sorted((-s, i) for h, s, i, _ in rows if h == g and s is not None)[:3]
        want += [(g or "", k + 1, -s, i) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert top_n_per_group(df.limit(0), ["g"], "score", ["id"], 3).count() == 0
