import math
import re

import numpy as np
import pyarrow as pa
from codestrata.operators import retrieval
from codestrata.plans import retrieval_queries


def test_rankings_pass_on_only_the_best_of_a_task(spark):
    q = spark.createDataFrame([("q1", "load the index"), ("q2", "the the"), ("q3", "")], "query_id string, text string")
    docs = [(f"d{i:03}", " ".join(["the"] * (1 + i % 3) + ["Load"] * (i % 2) + [f"w{i}"] * (i % 7))) for i in range(200)] + [("e", None)]
    corpus = spark.createDataFrame(docs, "doc_id string, text string").repartition(5)
    words = {d: (t or "").lower().split() for d, t in docs}
    asked, mean = {"q1": ["load", "the", "index"], "q2": ["the"]}, sum(map(len, words.values())) / len(words)
    df = {t: sum(t in w for w in words.values()) for t in ("load", "the", "index")}
    part = lambda t, w: math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / mean))
    scores = {"overlap": lambda ts, w: round(sum(t in w for t in ts) / len(ts), 9), "bm25": lambda ts, w: round(sum(part(t, w) for t in ts), 6)}
    best = lambda score, k: {(q, d, r) for q, ts in asked.items() for r, (s, d) in enumerate(sorted((-score(ts, w), d) for d, w in words.items() if score(ts, w) > 0)[:k], 1)}
    both = retrieval.lexical_rankings(q, corpus, 7, 9)
    for name, k, got in (("overlap", 7, retrieval.overlap_ranking(q, corpus, 7)), ("bm25", 9, retrieval.bm25_ranking(q, corpus, 9)), ("overlap", 7, both[0]), ("bm25", 9, both[1])):
        rows = got.collect()
        assert {(r["query_id"], r["doc_id"], r["rank"]) for r in rows} == best(scores[name], k)
        assert all(abs(r["score"] - scores[name](asked[r["query_id"]], words[r["doc_id"]])) < 2e-6 for r in rows)
        # No pair of query and document is shuffled.
        assert not re.search(r"hashpartitioning\(query_id#\d+, doc_id", got._jdf.queryExecution().toString())
    assert retrieval.bm25_ranking(q.limit(0), corpus).count() == 0 and retrieval.overlap_ranking(q, corpus.limit(0)).count() == 0 and retrieval.bm25_ranking(q, corpus.limit(0)).count() == 0


def test_rankings_of_a_task_in_parts(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CELLS", 6)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 1)
    q = spark.createDataFrame([(1, "a b"), (2, "b c")], "query_id int, text string")
    blocks = sorted(retrieval._asked(q), key=lambda a: a.ids)
    assert [a.ids for a in blocks] == [[1], [2]] and [a.words for a in blocks] == [["a", "b"], ["b", "c"]]
    ids = list(range(100, 0, -1))
    for a in blocks:
        batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([["a"] * (i % 3) + ["b"] * (i % 5) for i in ids], pa.list_(pa.string()))], ["doc_id", "t"])
        counts = list(retrieval._count(iter([batch.slice(0, 60), batch.slice(60)]), a.words))
        out = list(retrieval._tops(iter(counts), a, 4, lambda t, tf, dl: tf, np.ones(1), 6, pa.int32()))
        expected = sorted((-((i % 3) * ("a" in a.words) + i % 5), i) for i in ids)[:4]
        assert sorted(zip([-s for s in out[0]["score"].to_pylist()], out[0]["doc_id"].to_pylist())) == expected and out[0]["query_id"].to_pylist() == a.ids * 4


def test_fusion_writes_no_copy_of_the_corpus(spark, sf_dir, monkeypatch):
    def refused(df):
        raise AssertionError("the corpus was written")

    monkeypatch.setattr(retrieval_queries, "cut", refused)
    fused = retrieval_queries.rank_fusion(spark, sf_dir)
    assert fused.columns == ["query_id", "id", "fused"] and not re.search(r"hashpartitioning\(query_id#\d+, doc_id", fused._jdf.queryExecution().toString())
