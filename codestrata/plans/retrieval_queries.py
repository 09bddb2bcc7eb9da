"""Queries over questions, documents, entities and embeddings: retrieval and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.operators import evaluation as E
from codestrata.operators import retrieval as T
from codestrata.operators.records import current_records
from codestrata.plans.tables import CURRENT_SQL, table
from codestrata.session import cut


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "questions").select(F.col("id").alias("query_id"), F.col("query").alias("text"))


def _corpus(spark, sf_dir):
    """Entities as documents: name, signature and docstring."""
    r = current_records(table(spark, sf_dir, "repo_graph"), ["entity_type", "name", "signature", "docstring"])
    return r.select(F.col("uid").alias("doc_id"), "name", F.concat_ws(" ", "name", "signature", "docstring").alias("text"))


def document_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    t = T.tokens(F.col("text"))
    return d.select("doc_id", F.size(t).cast("bigint").alias("tokens"), F.size(F.array_distinct(t)).cast("bigint").alias("distinct_tokens"), T.token_estimate(F.col("text")).cast("bigint").alias("estimate"))


def lexical_overlap_topk(spark, sf_dir):
    return T.overlap_ranking(_questions(spark, sf_dir), _corpus(spark, sf_dir))


def bm25_topk(spark, sf_dir):
    return T.bm25_ranking(_questions(spark, sf_dir), _corpus(spark, sf_dir))


def _embedded(spark, sf_dir):
    """Entities as the index holds them: what is embedded, a vector of it, and the metadata that filters read."""
    r = current_records(table(spark, sf_dir, "repo_graph"), ["entity_type", "name", "signature", "docstring", "parent_class", "calls", "bases"])
    return r.select(F.col("uid").alias("doc_id"), "name", F.col("file_path").alias("file"), F.col("entity_type").alias("type"), T.embed_text(r).alias("text"))


def embed_texts(spark, sf_dir):
    return _embedded(spark, sf_dir).select("doc_id", "text")


def _hybrid(spark, sf_dir):
    corpus, q = cut(_embedded(spark, sf_dir)), cut(_questions(spark, sf_dir))
    vectors = corpus.select("doc_id", T.hashed_vector(F.col("text")).alias("embedding"))
    return T.hybrid(q, corpus, vectors, q.select("query_id", T.hashed_vector(F.col("text")).alias("embedding"))), corpus


def hybrid_topk(spark, sf_dir):
    return _hybrid(spark, sf_dir)[0][0]


def hybrid_trace(spark, sf_dir):
    return _hybrid(spark, sf_dir)[0][1]


def knn_cosine_topk(spark, sf_dir):
    """Every vector whose id 50 divides, against all vectors."""
    v = table(spark, sf_dir, "embeddings")
    return T.vector_ranking(v.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding"), v)


def knn_dot_topk(spark, sf_dir):
    """The same by inner product."""
    v = table(spark, sf_dir, "embeddings")
    return T.vector_ranking(v.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding"), v, metric="dot")


def rank_fusion(spark, sf_dir):
    lex, bm = T.lexical_rankings(_questions(spark, sf_dir), _corpus(spark, sf_dir), 24, 30)
    return T.fuse_rankings(bm.withColumnRenamed("doc_id", "id"), lex.withColumnRenamed("doc_id", "id"))


def rerank(spark, sf_dir):
    corpus = cut(_corpus(spark, sf_dir))
    q = _questions(spark, sf_dir)
    top = T.overlap_ranking(q, corpus, 24)
    rows = top.join(q.withColumnRenamed("text", "query"), "query_id").join(corpus.withColumnRenamed("text", "document"), "doc_id")
    c = rows.select("query_id", F.col("doc_id").alias("id"), F.round(1 / (60 + F.col("rank")), 9).alias("fused"), "query", "document", "name")
    return T.rerank(c).select("query_id", "id", "score")


def intent_detect(spark, sf_dir):
    return table(spark, sf_dir, "questions").select("id", T.detect_intent(F.col("query")).alias("intent"))


def dynamic_top_k(spark, sf_dir):
    q = table(spark, sf_dir, "questions")
    return q.select("id", T.dynamic_k(T.detect_intent(F.col("query")), F.size("expected_entities") / 5).alias("k"))


def metadata_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    hint, kind = T.query_filters(F.col("text"))
    return d.select("doc_id", hint.alias("file_hint"), kind.alias("entity_type")).where(F.col("file_hint").isNotNull() | F.col("entity_type").isNotNull())


def context_pack(spark, sf_dir):
    corpus = cut(_corpus(spark, sf_dir))
    top = T.overlap_ranking(_questions(spark, sf_dir), corpus, 8).join(corpus, "doc_id")
    return T.pack_context(top.select("query_id", "rank", F.col("doc_id").alias("id"), F.col("text").alias("document")))


def answer_grounding(spark, sf_dir):
    q = table(spark, sf_dir, "questions")
    return T.grounding(q.select("id", "answer", F.col("query").alias("evidence")))


def eval_metrics(spark, sf_dir):
    q = table(spark, sf_dir, "questions")
    return E.entity_recall(q.withColumn("evidence", F.col("query"))).join(E.relevancy(q), "id").join(E.faithfulness(answer_grounding(spark, sf_dir)), "id")


def eval_aggregate(spark, sf_dir):
    m = cut(eval_metrics(spark, sf_dir).join(table(spark, sf_dir, "questions").select("id", "category", F.length("answer").alias("size")), "id"))
    means = m.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("relevancy"), 6).alias("relevancy"), F.round(F.avg("faithfulness"), 6).alias("faithfulness"))
    return means.join(E.nearest_rank(m, ["category"], "size").select("category", F.col("p").cast("bigint").alias("p95_size")), "category")


def _measured(spark, sf_dir, ranked, corpus):
    """One row of measures over all questions for a ranking(query_id, id, rank): precision of its first hits, recall in them, cost of reading them."""
    q = table(spark, sf_dir, "questions")
    hits = ranked.where(F.col("rank") <= 4).join(corpus.select(F.col("doc_id").alias("doc"), "name", "file", "text"), F.col("id") == F.col("doc")).select(F.col("query_id").alias("id"), "doc", "name", "file", "text", "rank")
    hits = cut(hits)
    evidence = hits.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc", "text"))), lambda x: F.concat_ws(" ", x["doc"], x["text"])), "\n").alias("evidence"))
    full = cut(q.join(evidence, "id", "left").withColumn("evidence", F.coalesce("evidence", F.lit(""))))
    g = T.grounding(full.select("id", "answer", "evidence"))
    cost = full.select("id", T.answer_cost(T.token_estimate(F.col("evidence")), T.token_estimate(F.col("answer"))).alias("cost"))
    m = E.faithfulness(g).join(E.relevancy(full), "id").join(E.precision_at(hits, q), "id").join(E.entity_recall(full.withColumn("answer", F.lit(""))), "id").join(cost, "id")
    mean = lambda c, d=6: F.round(F.avg(c), d).alias(c)
    return m.agg(mean("faithfulness"), mean("relevancy"), mean("precision"), mean("recall"), F.lit(None).cast("double").alias("p95_ms"), mean("cost", 10))


def _two_rankings(spark, sf_dir):
    (ranked, _), corpus = _hybrid(spark, sf_dir)
    lexical = T.overlap_ranking(_questions(spark, sf_dir), corpus, 4).withColumnRenamed("doc_id", "id")
    return cut(_measured(spark, sf_dir, ranked, corpus)), cut(_measured(spark, sf_dir, lexical, corpus))


def eval_rankings(spark, sf_dir):
    """Measures of the whole search and of the lexical ranking alone, over all questions."""
    now, before = _two_rankings(spark, sf_dir)
    return now.withColumn("ranking", F.lit("hybrid")).unionByName(before.withColumn("ranking", F.lit("lexical"))).drop("p95_ms")


def eval_gate(spark, sf_dir):
    """The whole search against the lexical ranking alone as its baseline."""
    return E.gate(*_two_rankings(spark, sf_dir))


QUERIES = {f.__name__: f for f in (document_tokens, lexical_overlap_topk, bm25_topk, knn_cosine_topk, knn_dot_topk, embed_texts, hybrid_topk, hybrid_trace, rank_fusion, rerank, intent_detect, dynamic_top_k, metadata_filter, context_pack, answer_grounding, eval_metrics, eval_aggregate, eval_rankings, eval_gate)}

_TOK = "list_transform(regexp_extract_all(coalesce({0}, ''), '" + T.TOKEN + "'), lambda t: lower(t))"
_CORPUS = CURRENT_SQL + ", corpus AS (SELECT uid AS doc_id, name, concat_ws(' ', name, signature, docstring) AS text FROM cur)"
_OVERLAP = f"""qt AS (SELECT id AS query_id, unnest(list_distinct({_TOK.format('query')})) AS token FROM questions), qn AS (SELECT query_id, count(*) AS n FROM qt GROUP BY query_id),
dt AS (SELECT doc_id, unnest(list_distinct({_TOK.format('text')})) AS token FROM corpus),
hit AS (SELECT query_id, doc_id, count(*) AS h FROM dt JOIN qt USING (token) GROUP BY ALL),
ov AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(h / n, 9) AS score FROM hit JOIN qn USING (query_id)))"""
_BM = f"""bt AS (SELECT doc_id, {_TOK.format('text')} AS t FROM corpus), st AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM bt),
tf AS (SELECT doc_id, dl, token, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS token FROM bt) GROUP BY ALL), dfs AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN tf USING (token) JOIN dfs USING (token), st GROUP BY ALL) WHERE score > 0)"""
_COUNTS = ", ".join("(" + " + ".join(f"regexp_matches(low, '{p}')::INT" for p in ps) + f") AS c_{k}" for k, ps in T.INTENTS.items())
_INTENT = f"""ic AS (SELECT id, {_COUNTS} FROM (SELECT id, lower(coalesce(query, '')) AS low FROM questions)),
it AS (SELECT id, CASE WHEN greatest({", ".join("c_" + k for k in T.INTENTS)}) = 0 THEN 'general' {" ".join(f"WHEN c_{k} = greatest({', '.join('c_' + x for x in T.INTENTS)}) THEN '{k}'" for k in T.INTENTS)} END AS intent FROM ic)"""
_GROUND = f"""gs AS (SELECT id, list_distinct({_TOK.format('query')}) AS e, unnest(regexp_split_to_array(trim(coalesce(answer, '')), '[.!?]\\s+')) AS s FROM questions),
gt AS (SELECT id, e, list_distinct({_TOK.format('s')}) AS t FROM gs), gg AS (SELECT id, count(*) AS sentences, count(*) FILTER (len(list_intersect(t, e)) / len(t) < 0.15) AS unsupported FROM gt WHERE len(t) > 0 GROUP BY id),
ground AS (SELECT id, sentences, unsupported, unsupported = 0 AS grounded FROM gg)"""
_LONG = "list_filter(list_distinct(" + _TOK + "), lambda t: length(t) > 2)"
_EVAL = f"""{_GROUND}, ex AS (SELECT id, category, answer, list_distinct(list_filter(coalesce(expected_entities, []), lambda e: e IS NOT NULL AND e <> '')) AS x, lower(concat_ws(' ', answer, query)) AS txt, {_LONG.format('query')} AS q, {_LONG.format('answer')} AS a FROM questions),
ev AS (SELECT id, category, length(answer) AS size, CASE WHEN len(x) > 0 THEN round(len(list_filter(x, lambda e: contains(txt, lower(e)))) / len(x), 6) ELSE 0 END AS recall,
  CASE WHEN len(q) > 0 THEN round(len(list_intersect(q, a)) / len(q), 6) ELSE 0 END AS relevancy,
  round((CASE WHEN grounded THEN greatest(greatest(0.0, 1 - least(1.0, 0.34 * unsupported)), 0.8) ELSE greatest(0.0, 1 - least(1.0, 0.34 * unsupported)) END)::DOUBLE, 6) AS faithfulness FROM ex JOIN ground USING (id)),
agg AS (SELECT category, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(relevancy), 6) AS relevancy, round(avg(faithfulness), 6) AS faithfulness, quantile_disc(size, 0.95) AS p95_size FROM ev GROUP BY category)"""

_EMBED = CURRENT_SQL + r""", corpus AS (SELECT uid AS doc_id, name, fpath AS file, entity_type AS type, concat_ws(chr(10), concat_ws(' ', upper(entity_type[1]) || lower(entity_type[2:]), name), CASE WHEN fpath <> '' THEN 'File: ' || fpath END, CASE WHEN parent_class <> '' THEN 'Class: ' || parent_class END,
  CASE WHEN signature <> '' THEN 'Signature: ' || signature END, CASE WHEN docstring <> '' THEN 'Description: ' || docstring END,
  'Extends: ' || nullif(array_to_string(list_filter(coalesce(bases, []), lambda c: c IS NOT NULL AND c <> ''), ', '), ''),
  'Calls: ' || nullif(array_to_string(list_slice(list_filter(coalesce(calls, []), lambda c: c IS NOT NULL AND c <> '' AND NOT starts_with(c, 'self.')), 1, 10), ', '), '')) AS text FROM cur)"""
_VEC = "list_transform(range(64), lambda i: len(list_filter(list_transform({0}, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % 64), lambda p: p = i))::DOUBLE)"
_HYBRID = f"""{_EMBED}, {_OVERLAP}, qv AS (SELECT id AS query_id, query, {_VEC.format(_TOK.format("query"))} AS e FROM questions), dv AS (SELECT doc_id, {_VEC.format(_TOK.format("text"))} AS e FROM corpus),
vs AS (SELECT q.query_id, d.doc_id, round(greatest(0.0, list_dot_product(q.e, d.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(d.e, d.e)))), 6) AS score FROM qv q, dv d WHERE list_dot_product(q.e, q.e) > 0 AND list_dot_product(d.e, d.e) > 0),
sem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM vs) WHERE rank <= 24), lex AS (SELECT * FROM ov WHERE rank <= 30),
fu AS (SELECT coalesce(s.query_id, l.query_id) AS query_id, coalesce(s.doc_id, l.doc_id) AS id, round(coalesce(1 / (60 + s.rank), 0) + coalesce(1 / (60 + l.rank), 0), 9) AS fused FROM sem s FULL JOIN lex l ON s.query_id = l.query_id AND s.doc_id = l.doc_id),
ab AS (SELECT id AS query_id, query, list_distinct({_TOK.format("query")}) AS qt, nullif(regexp_extract(query, '(?i)\\b(?:file|module|path):([A-Za-z0-9_./-]+)', 1), '') AS hint, CASE WHEN lower(regexp_extract(query, '(?i)\\b(function|class|method|module)\\b', 1)) = 'method' THEN 'function' ELSE nullif(lower(regexp_extract(query, '(?i)\\b(function|class|method|module)\\b', 1)), '') END AS kind FROM questions),
ro AS (SELECT f.*, c.name, c.file, c.text, a.query, a.qt, a.hint, (a.hint IS NULL OR contains(coalesce(c.file, ''), a.hint)) AND (a.kind IS NULL OR coalesce(c.type = a.kind, false)) AS fits FROM fu f JOIN corpus c ON c.doc_id = f.id JOIN ab a ON a.query_id = f.query_id),
fi AS (SELECT * FROM (SELECT *, bool_or(fits) OVER (PARTITION BY query_id) AS any_ FROM ro) WHERE fits OR NOT any_),
re AS (SELECT *, round(0.58::DOUBLE * fused + 0.42::DOUBLE * CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, {_TOK.format("text")})) / len(qt) ELSE 0 END + 0.06::DOUBLE * len(list_filter(qt, lambda t: contains(lower(coalesce(name, '')), t))) + 1e-9, 6) AS sc FROM fi),
bo AS (SELECT query_id, id, max(round(sc + CASE WHEN hint IS NOT NULL AND contains(coalesce(file, ''), hint) THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN coalesce(name, '') <> '' AND contains(lower(query), lower(name)) THEN 0.08::DOUBLE ELSE 0 END, 6)) AS score FROM re GROUP BY ALL),
hy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bo) WHERE rank <= 30)"""


def _measures(name: str, ranking: str) -> str:
    return f"""{name}h AS (SELECT r.query_id AS id, r.rank, c.doc_id AS doc, c.name, c.file, c.text FROM {ranking} r JOIN corpus c ON c.doc_id = r.id WHERE r.rank <= 4),
{name}e AS (SELECT id, string_agg(concat_ws(' ', doc, text), chr(10) ORDER BY rank) AS ev FROM {name}h GROUP BY id),
{name}q AS (SELECT q.*, coalesce(e.ev, '') AS ev, list_distinct(list_filter(coalesce(expected_entities, []), lambda x: x IS NOT NULL AND x <> '')) AS x, {_LONG.format("query")} AS ql, {_LONG.format("answer")} AS al FROM questions q LEFT JOIN {name}e e USING (id)),
{name}s AS (SELECT id, list_distinct({_TOK.format("ev")}) AS e, unnest(regexp_split_to_array(trim(coalesce(answer, '')), '[.!?]\\s+')) AS s FROM {name}q), {name}t AS (SELECT id, e, list_distinct({_TOK.format("s")}) AS t FROM {name}s),
{name}g AS (SELECT id, count(*) FILTER (len(list_intersect(t, e)) / len(t) < 0.15) AS u FROM {name}t WHERE len(t) > 0 GROUP BY id),
{name}p AS (SELECT q.id, round(coalesce(avg((coalesce(list_contains(list_transform(q.expected_entities, lambda x: lower(x)), lower(h.name)), false) OR coalesce(list_contains(list_transform(q.expected_entities, lambda x: lower(x)), lower(h.file)), false))::INT::DOUBLE) FILTER (h.rank IS NOT NULL), 0.0), 6) AS pr FROM {name}q q LEFT JOIN {name}h h USING (id) GROUP BY q.id),
{name}c AS (SELECT id, CASE WHEN len(list_filter(regexp_split_to_array(ev, '\\s+'), lambda w: w <> '')) = 0 THEN 0 ELSE greatest(1, floor(len(list_filter(regexp_split_to_array(ev, '\\s+'), lambda w: w <> '')) * 1.25)) END AS i,
  CASE WHEN len(list_filter(regexp_split_to_array(coalesce(answer, ''), '\\s+'), lambda w: w <> '')) = 0 THEN 0 ELSE greatest(1, floor(len(list_filter(regexp_split_to_array(coalesce(answer, ''), '\\s+'), lambda w: w <> '')) * 1.25)) END AS o FROM {name}q),
{name} AS (SELECT round(avg(round((CASE WHEN g.u = 0 THEN greatest(greatest(0.0, 1 - least(1.0, 0.34 * g.u)), 0.8) ELSE greatest(0.0, 1 - least(1.0, 0.34 * g.u)) END)::DOUBLE, 6)), 6) AS faithfulness,
  round(avg(CASE WHEN len(q.ql) > 0 THEN round(len(list_intersect(q.ql, q.al)) / len(q.ql), 6) ELSE 0 END), 6) AS relevancy, round(avg(p.pr), 6) AS precision,
  round(avg(CASE WHEN len(q.x) > 0 THEN round(len(list_filter(q.x, lambda e: contains(lower(concat_ws(' ', '', q.ev)), lower(e)))) / len(q.x), 6) ELSE 0 END), 6) AS recall, round(avg(round(c.i / 1e6 * 0.2::DOUBLE + c.o / 1e6 * 0.6::DOUBLE, 8)), 10) AS cost
  FROM {name}q q JOIN {name}g g USING (id) JOIN {name}p p USING (id) JOIN {name}c c USING (id))"""


_GATE = f"{_HYBRID}, lx AS (SELECT query_id, doc_id AS id, rank FROM ov WHERE rank <= 4), {_measures('mh', 'hy')}, {_measures('ml', 'lx')}"
SQL = {
    "document_tokens": f"""SELECT doc_id, len(t) AS tokens, len(list_distinct(t)) AS distinct_tokens, CASE WHEN w = 0 THEN 0 ELSE greatest(1, floor(w * 1.25)) END::BIGINT AS estimate
FROM (SELECT doc_id, {_TOK.format('text')} AS t, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w FROM documents WHERE text IS NOT NULL)""",
    "lexical_overlap_topk": f"WITH {_CORPUS}, {_OVERLAP} SELECT query_id, doc_id, score, rank::INT AS rank FROM ov WHERE rank <= 30",
    "bm25_topk": f"WITH {_CORPUS}, {_OVERLAP}, {_BM} SELECT query_id, doc_id, score, rank::INT AS rank FROM bm WHERE rank <= 30",
    "knn_cosine_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(greatest(0.0, list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e)))), 6) AS score FROM v q, v WHERE q.vec_id % 50 = 0)
SELECT query_id, vec_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 24""",
    "rank_fusion": f"""WITH {_CORPUS}, {_OVERLAP}, {_BM} SELECT coalesce(b.query_id, o.query_id) AS query_id, coalesce(b.doc_id, o.doc_id) AS id, round(coalesce(1 / (60 + b.rank), 0) + coalesce(1 / (60 + o.rank), 0), 9) AS fused
FROM (SELECT * FROM bm WHERE rank <= 30) b FULL JOIN (SELECT * FROM ov WHERE rank <= 24) o ON b.query_id = o.query_id AND b.doc_id = o.doc_id""",
    "rerank": f"""WITH {_CORPUS}, {_OVERLAP}, c AS (SELECT o.query_id, o.doc_id AS id, round(1 / (60 + rank), 9) AS fused, list_distinct({_TOK.format('q.query')}) AS q, {_TOK.format('c.text')} AS d, lower(coalesce(c.name, '')) AS nm
  FROM ov o JOIN questions q ON q.id = o.query_id JOIN corpus c ON c.doc_id = o.doc_id WHERE rank <= 24)
SELECT query_id, id, round(0.58::DOUBLE * fused + 0.42::DOUBLE * CASE WHEN len(q) > 0 THEN len(list_intersect(q, d)) / len(q) ELSE 0 END + 0.06::DOUBLE * len(list_filter(q, lambda t: contains(nm, t))) + 1e-9, 6) AS score FROM c""",
    "intent_detect": f"WITH {_INTENT} SELECT * FROM it",
    "dynamic_top_k": f"""WITH {_INTENT}, k AS (SELECT id, CASE WHEN intent IN ('architecture', 'governance', 'blast_radius', 'debug') THEN 6 ELSE 4 END AS k, len(expected_entities) / 5 AS c FROM it JOIN questions USING (id))
SELECT id, CASE WHEN c < 0.45 THEN greatest(k, 8) ELSE k END::INT AS k FROM k""",
    "metadata_filter": r"""SELECT * FROM (SELECT doc_id, nullif(regexp_extract(text, '(?i)\b(?:file|module|path):([A-Za-z0-9_./-]+)', 1), '') AS file_hint,
  CASE WHEN lower(regexp_extract(text, '(?i)\b(function|class|method|module)\b', 1)) = 'method' THEN 'function' ELSE nullif(lower(regexp_extract(text, '(?i)\b(function|class|method|module)\b', 1)), '') END AS entity_type
  FROM documents WHERE text IS NOT NULL) WHERE file_hint IS NOT NULL OR entity_type IS NOT NULL""",
    "answer_grounding": f"WITH {_GROUND} SELECT * FROM ground",
    "eval_metrics": f"WITH {_EVAL} SELECT id, recall, relevancy, faithfulness FROM ev",
    "eval_aggregate": f"WITH {_EVAL} SELECT * FROM agg",
    "knn_dot_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.e, v.e), 6) AS score FROM v q, v WHERE q.vec_id % 50 = 0)
SELECT query_id, vec_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 24""",
    "embed_texts": f"WITH {_EMBED} SELECT doc_id, text FROM corpus",
    "hybrid_topk": f"WITH {_HYBRID} SELECT query_id, id, score, rank::INT AS rank FROM hy",
    "hybrid_trace": f"WITH {_HYBRID} SELECT id AS query_id, (SELECT count(*) FROM sem s WHERE s.query_id = q.id) AS semantic, (SELECT count(*) FROM lex s WHERE s.query_id = q.id) AS lexical, (SELECT count(*) FROM fu s WHERE s.query_id = q.id) AS fused, (SELECT count(*) FROM hy s WHERE s.query_id = q.id) AS kept FROM questions q",
    "context_pack": f"""WITH RECURSIVE {_CORPUS}, {_OVERLAP}, r AS (SELECT o.query_id, o.doc_id AS id, o.rank::INT AS rank, len(list_filter(regexp_split_to_array(c.text, '\\s+'), lambda w: w <> '')) AS w FROM ov o JOIN corpus c USING (doc_id) WHERE o.rank <= 8),
k AS (SELECT query_id, id, rank, CASE WHEN w = 0 THEN 0 ELSE greatest(1, floor(w * 1.25)) END::INT AS cost FROM r),
g AS (SELECT query_id, 0 AS rank, '' AS id, 0 AS cost, 0 AS used, false AS kept FROM (SELECT DISTINCT query_id FROM k) UNION ALL SELECT k.query_id, k.rank, k.id, k.cost, CASE WHEN g.used + k.cost <= 1700 THEN g.used + k.cost ELSE g.used END, g.used + k.cost <= 1700 FROM g JOIN k ON k.query_id = g.query_id AND k.rank = g.rank + 1)
SELECT query_id, rank, id, cost FROM g WHERE kept""",
    "eval_rankings": f"WITH {_GATE} SELECT *, 'hybrid' AS ranking FROM mh UNION ALL SELECT *, 'lexical' FROM ml",
    "eval_gate": f"""WITH {_GATE}, y AS (SELECT (round(h.faithfulness - l.faithfulness, 9) < -0.02)::INT + (round(h.relevancy - l.relevancy, 9) < -0.02)::INT AS failures,
  (round(h.precision - l.precision, 9) < -0.03)::INT + (round(h.recall - l.recall, 9) < -0.03)::INT + (l.cost > 0 AND h.cost / l.cost > 1.25)::INT AS warnings FROM mh h, ml l)
SELECT CASE WHEN failures > 0 THEN 'fail' WHEN warnings > 0 THEN 'warn' ELSE 'pass' END AS status, failures, warnings FROM y""",
}
