"""Hybrid retrieval: tokens, lexical and vector ranking, fusion, reranking, packing, grounding, intent."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from codestrata.session import cut, share_package, written

TOKEN = "[A-Za-z_][A-Za-z0-9_./:-]*"
#: Patterns of each intent, in the order that settles ties.
INTENTS = {
    "blast_radius": [r"\bblast\s*radius\b", r"\bimpact\b", r"\baffect(?:s|ed)?\b", r"\bbreak(?:s|ing)?\b", r"\bdependen(?:cy|cies|t|ts)\b", r"\bripple\b", r"\bdownstream\b", r"\bupstream\b", r"\brisk(?:y|s)?\b", r"\bchange.*(?:safe|dangerous)\b", r"\bwhat.*(?:breaks?|happens)\b"],
    "governance": [r"\barchitect(?:ure|ural)\b", r"\bviolat(?:ion|ions|es?|ing)\b", r"\blayer(?:s|ing)?\b", r"\bboundar(?:y|ies)\b", r"\bdrift\b", r"\brule(?:s)?\b", r"\bgovernance\b", r"\bcoupling\b", r"\bcohesion\b", r"\bimport.*(?:cross|violat)\b"],
    "expertise": [r"\bwho\b.*\b(?:knows?|expert|owns?|wrote|author)\b", r"\bexpert(?:ise|s)?\b", r"\bblame\b", r"\bowner(?:ship)?\b", r"\bbus\s*factor\b", r"\bheatmap\b", r"\bknowledge\s*gap\b", r"\bask\s+(?:about|for)\b", r"\bcontribut(?:or|ions?)\b", r"\bresponsib(?:le|ility)\b"],
    "complexity": [r"\bcomplex(?:ity)?\b", r"\bcyclomatic\b", r"\bcognitive\b", r"\brefactor\b", r"\bsimplif(?:y|ied|ication)\b", r"\blines?\s*of\s*code\b", r"\bloc\b", r"\btoo\s*(?:big|long|complex)\b", r"\bcode\s*smell\b"],
}


def tokens(text: Column) -> Column:
    """Identifier-like tokens in lower case, with repeats; null text gives none."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TOKEN})"), F.lit(1)), lambda t: F.lower(t))


def token_estimate(text: Column) -> Column:
    """max(1, int(1.25 words)) and 0 for blank text."""
    n = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n * 1.25))).cast("int")


#: A query side of at most so many rows is broadcast.
SMALL = 200_000


def small(df: DataFrame) -> DataFrame:
    """df, broadcast if it has been counted to be small: of a stated query set it is."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def _best(scored: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Asked(NamedTuple):
    """A block of the stated queries: their ids and numbers of tokens, all their tokens, and for token t the queries places[starts[t]:starts[t + 1]]."""

    ids: list
    sizes: np.ndarray
    words: list[str]
    starts: np.ndarray
    places: np.ndarray


def _asked(queries: DataFrame) -> Iterator[Asked]:
    """The stated queries(query_id, text), read once, in blocks of a bounded size; a query without tokens finds nothing and is left out."""
    q = cut(queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("t")).where(F.size("t") > 0))
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    for b in range(blocks):
        rows = q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        if rows:
            words = sorted({t for r in rows for t in r["t"]})
            at = {t: i for i, t in enumerate(words)}
            pairs = np.array(sorted((at[t], i) for i, r in enumerate(rows) for t in r["t"]))
            yield Asked([r["query_id"] for r in rows], np.array([len(r["t"]) for r in rows]), words, np.searchsorted(pairs[:, 0], np.arange(len(words) + 1)), pairs[:, 1])


def _count(batches: Iterator[pa.RecordBatch], words: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, t = batch.columns
        n = pc.list_value_length(t).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = t.flatten()
        found = pc.fill_null(pc.index_in(flat, value_set=pa.array(words, flat.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(n)), n)
        key, tf = np.unique((doc * len(words) + found)[found >= 0], return_counts=True)
        ends = pa.array(np.searchsorted(key, np.arange(len(n) + 1) * len(words)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (key % len(words), tf)]
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int32()), *lists], ["doc_id", "dl", "t", "tf"])


def _counted(asked: Asked, corpus: DataFrame) -> DataFrame:
    """(doc_id, dl, t, tf), one row a document: its length, and the numbers and counts of the queries' tokens in it."""
    share_package(corpus.sparkSession)
    words = corpus.sparkSession.sparkContext.broadcast(asked.words)
    schema = T.StructType([T.StructField("doc_id", corpus.schema["doc_id"].dataType), T.StructField("dl", T.IntegerType()), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("t", "tf"))])
    return corpus.select("doc_id", tokens(F.col("text")).alias("t")).mapInArrow(lambda batches: _count(batches, words.value), schema)


#: Scores of pairs of query and document that a task holds at a time.
CELLS = 2_000_000


def _firsts(q: np.ndarray, score: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The k rows of every query with the highest scores, of equal ones those with the first ids."""
    order = pc.sort_indices(pa.table({"q": q, "s": score, "d": ids}), [("q", "ascending"), ("s", "descending"), ("d", "ascending")], null_placement="at_start").to_numpy()
    place = np.arange(len(order)) - np.searchsorted(q[order], q[order])
    order = order[place < k]
    return q[order], score[order], ids.take(pa.array(order))


def _tops(batches: Iterator[pa.RecordBatch], asked: Asked, k: int, weight: Callable, scale: np.ndarray, digits: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Of _counted rows those that are among the k best of a query in this task; a score is the sum of weight(t, tf, dl) times the query's scale, rounded."""
    n_queries, unit = len(asked.ids), 10**digits
    held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
    merge = lambda: _firsts(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), pa.concat_arrays([x[2] for x in held]), k)
    for batch in batches:
        for at in range(0, batch.num_rows, step := max(1, CELLS // n_queries)):
            ids, dl, t, tf = batch.slice(at, step).columns
            n = len(ids)
            by_id = pc.sort_indices(ids, null_placement="at_start").to_numpy()
            column = np.empty(n, np.int64)
            column[by_id] = np.arange(n)
            doc = np.repeat(np.arange(n), pc.list_value_length(t).to_numpy(zero_copy_only=False))
            t, tf, dl = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (t.flatten(), tf.flatten(), dl))
            times = asked.starts[t + 1] - asked.starts[t]
            query = asked.places[np.arange(times.sum()) + np.repeat(asked.starts[t] - np.cumsum(times) + times, times)]
            cells = np.bincount(query * n + np.repeat(column[doc], times), np.repeat(weight(t, tf, dl[doc]), times), n_queries * n).reshape(n_queries, n)
            score = np.rint(cells * scale[:, None] * unit).astype(np.int64)
            # Columns are in the order of ids: one number says which of two documents comes first.
            best = np.argpartition(np.arange(n) - score * n, k - 1, axis=1)[:, :k] if n > k else np.broadcast_to(np.arange(n), (n_queries, n))
            q, c = np.repeat(np.arange(n_queries), best.shape[1]), best.ravel()
            q, c = q[score[q, c] > 0], c[score[q, c] > 0]
            held.append((q, score[q, c], ids.take(pa.array(by_id[c]))))
            if sum(len(x[0]) for x in held) > 8 * k * n_queries:
                held = [merge()]
    if held:
        q, score, ids = merge()
        yield pa.RecordBatch.from_arrays([pa.array(asked.ids, kind).take(pa.array(q)), ids, pa.array(score / unit)], ["query_id", "doc_id", "score"])


def _scored(counts: DataFrame, query_id: T.DataType, asked: Asked, k: int, weight: Callable, scale: np.ndarray, digits: int) -> DataFrame:
    """(query_id, doc_id, score): the k best documents of every query in every task. No pair of query and document is a row before that."""
    held = counts.sparkSession.sparkContext.broadcast((asked, scale))
    schema = T.StructType([T.StructField("query_id", query_id), T.StructField("doc_id", counts.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
    kind = to_arrow_type(query_id)
    return counts.mapInArrow(lambda batches: _tops(batches, held.value[0], k, weight, held.value[1], digits, kind), schema)


def _overlap(counts: DataFrame, query_id: T.DataType, asked: Asked, k: int) -> DataFrame:
    return _scored(counts, query_id, asked, k, lambda t, tf, dl: np.ones(len(t)), 1 / asked.sizes, 9)


def _bm25(counts: DataFrame, query_id: T.DataType, asked: Asked, k: int, k1: float, b: float) -> DataFrame:
    n, length = counts.agg(F.count("*"), F.sum("dl")).first()
    df = np.zeros(len(asked.words))
    for r in counts.select(F.explode("t").alias("t")).groupBy("t").count().collect():  # at most a row a token of the block
        df[r["t"]] = r["count"]
    idf, mean = np.log(1 + (n - df + 0.5) / (df + 0.5)), (length or 0) / max(n, 1) or 1.0
    return _scored(counts, query_id, asked, k, lambda t, tf, dl: idf[t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean)), np.ones(len(asked.ids)), 6)


def _union(parts: list[DataFrame], queries: DataFrame, corpus: DataFrame) -> DataFrame:
    schema = T.StructType([queries.schema["query_id"], corpus.schema["doc_id"], T.StructField("score", T.DoubleType())])
    return reduce(DataFrame.unionByName, parts) if parts else queries.sparkSession.createDataFrame([], schema)


def overlap_ranking(queries: DataFrame, corpus: DataFrame, k: int = 30) -> DataFrame:
    """(query_id, doc_id, score, rank): share of a query's distinct tokens found in the document. Ties by id.

    queries(query_id, text) is the stated side, read once. A document is scored for all queries where it is read, and a
    task passes on the k best of every query only.
    """
    kind = queries.schema["query_id"].dataType
    return _best(_union([_overlap(_counted(a, corpus), kind, a, k) for a in _asked(queries)], queries, corpus), k)


def bm25_ranking(queries: DataFrame, corpus: DataFrame, k: int = 30, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, rank) with idf = ln(1 + (N - df + 0.5)/(df + 0.5)); positive scores only; ties by id.

    The corpus is read into tokens once: what is written is a row a document, with its length and the counts of the
    queries' tokens. Scores are made as in overlap_ranking.
    """
    kind = queries.schema["query_id"].dataType
    return _best(_union([_bm25(written(_counted(a, corpus)), kind, a, k, k1, b) for a in _asked(queries)], queries, corpus), k)


def lexical_rankings(queries: DataFrame, corpus: DataFrame, k_overlap: int, k_bm25: int, k1: float = 1.5, b: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """overlap_ranking and bm25_ranking of the same documents, which are read once for both."""
    kind = queries.schema["query_id"].dataType
    blocks = [(a, written(_counted(a, corpus))) for a in _asked(queries)]
    overlap = _union([_overlap(c, kind, a, k_overlap) for a, c in blocks], queries, corpus)
    return _best(overlap, k_overlap), _best(_union([_bm25(c, kind, a, k_bm25, k1, b) for a, c in blocks], queries, corpus), k_bm25)


#: Queries, or query vectors, that are held by every task at a time.
QUERY_BLOCK = 10_000


def vector_ranking(queries: DataFrame, vectors: DataFrame, k: int = 24, metric: str = "cosine", id_col: str = "vec_id", least: float | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): exact scores of a stated set of query vectors against all vectors, k best; ties by id.

    `metric` is cosine (negative ones count 0) or dot. The queries are taken in blocks of a bounded size; for a block each
    task multiplies matrices and passes on the k best of every query, so no pair of vectors is a row of any join. Vectors
    of another length or without any are left out; with `least` lower scores are too.
    """
    spark = queries.sparkSession
    q = cut(queries.where(F.col("embedding").isNotNull()).select(F.col("query_id"), "embedding"))
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    out = None
    schema = T.StructType([queries.schema["query_id"], T.StructField(id_col, vectors.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    for b in range(blocks):
        rows = q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        width = max(len(r["embedding"]) for r in rows)
        rows = [r for r in rows if len(r["embedding"]) == width]
        held = spark.sparkContext.broadcast(([r["query_id"] for r in rows], np.array([r["embedding"] for r in rows], float)))

        def score(batches: Iterator[pd.DataFrame], held=held, width=width) -> Iterator[pd.DataFrame]:
            ids, asked = held.value
            unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, np.nan)
            asked = unit(asked) if metric == "cosine" else asked
            best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for pdf in batches:
                pdf = pdf[[e is not None and len(e) == width for e in pdf["embedding"]]]
                if not len(pdf):
                    continue
                m = np.stack(pdf["embedding"].to_numpy()).astype(float)
                s = asked @ (unit(m) if metric == "cosine" else m).T
                s = np.round(np.maximum(s, 0) if metric == "cosine" else s, 6)
                # All that are as good as the k-th: ties are settled by id later.
                bound = np.partition(np.nan_to_num(s, nan=-np.inf), -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
                r, c = np.nonzero(s >= np.maximum(bound, -np.inf if least is None else least)[:, None])
                best.append((r, pdf[id_col].to_numpy()[c], s[r, c]))
            if best:
                r, v, s = (np.concatenate(x) for x in zip(*best))
                if not len(r):
                    return
                yield pd.DataFrame({"query_id": [ids[i] for i in r], id_col: v, "score": s})

        part = vectors.select(id_col, "embedding").mapInPandas(score, schema)
        out = part if out is None else out.unionByName(part)
    return _best(out if out is not None else spark.createDataFrame([], schema), k, id_col)


def hashed_vector(text: Column, width: int = 64) -> Column:
    """A vector that needs no model: how many tokens fall into each of `width` buckets by their MD5."""
    bucket = lambda t: F.pmod(F.conv(F.left(F.md5(t), F.lit(8)), 16, 10).cast("bigint"), F.lit(width))
    # The places are bound once: in the inner function they would be worked out for every bucket.
    count = lambda places: F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(width - 1).cast("bigint")), lambda i: (F.size(places) - F.size(F.array_remove(places, i))).cast("float"))
    return F.get(F.transform(F.array(F.transform(tokens(text), bucket)), count), F.lit(0))


def embed(df: DataFrame, text: str, model, column: str = "embedding") -> DataFrame:
    """df with vectors of an injected model(list of texts) -> list of vectors, called once a batch in the workers."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in v] for v in model(texts.fillna("").tolist())])

    return df.withColumn(column, run(F.col(text)))


def embed_text(entities: DataFrame) -> Column:
    """What a function or class is embedded as: kind and name, file, class, signature, documentation, bases and at most ten calls."""
    calls = F.slice(F.filter(F.coalesce("calls", F.array().cast("array<string>")), lambda c: c.isNotNull() & (c != "") & ~c.startswith("self.")), 1, 10)
    bases = F.filter(F.coalesce("bases", F.array().cast("array<string>")), lambda c: c.isNotNull() & (c != ""))
    line = lambda label, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(label), value))
    lines = [
        F.concat_ws(" ", F.initcap("entity_type"), "name"), line("File: ", F.col("file_path")), line("Class: ", F.col("parent_class")), line("Signature: ", F.col("signature")),
        line("Description: ", F.col("docstring")), line("Extends: ", F.array_join(bases, ", ")), line("Calls: ", F.array_join(calls, ", ")),
    ]
    return F.concat_ws("\n", *lines)


def is_stale(indexed: int, known: int) -> bool:
    """Whether an index has to be built anew: it is empty or holds another number of entities."""
    return indexed == 0 or indexed != known


def resolve_boosts(candidates: DataFrame, hint: Column) -> DataFrame:
    """candidates(query_id, id, score, query, name, file): 0.10 more for the hinted file, 0.08 for a name that the query holds; the best row of an id."""
    in_file = F.when(hint.isNotNull() & F.contains(F.coalesce("file", F.lit("")), hint), 0.10).otherwise(0.0)
    named = F.when((F.coalesce("name", F.lit("")) != "") & F.contains(F.lower("query"), F.lower("name")), 0.08).otherwise(0.0)
    return candidates.withColumn("score", F.round(F.col("score") + in_file + named, 6)).groupBy("query_id", "id").agg(F.max(F.struct("score", "name", "file")).alias("_b")).select("query_id", "id", "_b.*")


def hybrid(queries: DataFrame, corpus: DataFrame, vectors: DataFrame, query_vectors: DataFrame, least: float = 0.0, alpha: float = 0.58) -> tuple[DataFrame, DataFrame]:
    """(candidates, trace) of the whole search: 24 nearest vectors and 30 lexical hits, filtered by the hints in the query, fused, above `least`, reranked, boosted.

    corpus(doc_id, name, file, type, text). candidates(query_id, id, score, rank); the trace counts what each step has left
    for a query (semantic, lexical, fused, kept). A query whose filters leave nothing is answered without them.
    """
    semantic = cut(vector_ranking(query_vectors, vectors.withColumnRenamed("doc_id", "vec_id")).withColumnRenamed("vec_id", "doc_id"))
    lexical = cut(overlap_ranking(queries, corpus, 30))
    hint, kind = query_filters(F.col("text"))
    about = cut(queries.select("query_id", F.col("text").alias("query"), hint.alias("hint"), kind.alias("kind")))
    found = fuse_rankings(semantic.withColumnRenamed("doc_id", "id"), lexical.withColumnRenamed("doc_id", "id")).where(F.col("fused") > least)
    rows = found.join(corpus.select(F.col("doc_id").alias("id"), "name", "file", "type", F.col("text").alias("document")), "id").join(small(about), "query_id")
    fits = (F.col("hint").isNull() | F.contains(F.coalesce("file", F.lit("")), F.col("hint"))) & (F.col("kind").isNull() | F.coalesce(F.col("type") == F.col("kind"), F.lit(False)))
    rows = rows.withColumn("_fits", fits).withColumn("_any", F.max("_fits").over(Window.partitionBy("query_id"))).where(F.col("_fits") | ~F.col("_any"))
    ranked = cut(_best(resolve_boosts(rerank(rows, alpha).select("query_id", "id", "score", "query", "name", "file", "hint"), F.col("hint")), 30, "id"))
    count = lambda d, name: d.groupBy("query_id").agg(F.count("*").alias(name))
    trace = about.select("query_id")
    for d, name in ((semantic, "semantic"), (lexical, "lexical"), (found, "fused"), (ranked, "kept")):
        trace = trace.join(count(d, name), "query_id", "left")
    return ranked.select("query_id", "id", "score", "rank"), trace.na.fill(0)


def fuse_rankings(semantic: DataFrame, lexical: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, id, fused): reciprocal ranks 1/(k + rank) of two rankings(query_id, id, rank), added over a full outer join."""
    s = semantic.select("query_id", "id", F.col("rank").alias("_s"))
    x = lexical.select("query_id", "id", F.col("rank").alias("_x"))
    part = lambda c: F.coalesce(1 / (k + F.col(c)), F.lit(0.0))
    return s.join(x, ["query_id", "id"], "full_outer").select("query_id", "id", F.round(part("_s") + part("_x"), 9).alias("fused"))


def rerank(candidates: DataFrame, alpha: float = 0.58) -> DataFrame:
    """candidates(query_id, id, fused, query, document, name) with `score` = alpha fused + (1 - alpha) overlap + 0.06 per query token inside the name."""
    q = F.array_distinct(tokens(F.col("query")))
    overlap = F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(F.col("document")))) / F.size(q)).otherwise(0.0)
    inside = F.size(F.filter(q, lambda t: F.contains(F.lower(F.coalesce("name", F.lit(""))), t)))
    return candidates.withColumn("score", F.round(alpha * F.col("fused") + (1 - alpha) * overlap + 0.06 * inside + 1e-9, 6))


def dynamic_k(intent: Column, confidence: Column) -> Column:
    base = F.when(intent.isin("architecture", "governance", "blast_radius", "debug"), 6).otherwise(4)
    return F.when(confidence < 0.45, F.greatest(base, F.lit(8))).otherwise(base)


def query_filters(text: Column) -> tuple[Column, Column]:
    """(file hint, entity type) named in a query; null where none is."""
    hint = F.regexp_extract(text, r"(?i)\b(?:file|module|path):([A-Za-z0-9_./-]+)", 1)
    kind = F.lower(F.regexp_extract(text, r"(?i)\b(function|class|method|module)\b", 1))
    return F.when(hint != "", hint), F.when(kind == "method", "function").when(kind != "", kind)


def detect_intent(text: Column) -> Column:
    """The intent most of whose patterns match, the first of equals, else general."""
    low = F.lower(F.coalesce(text, F.lit("")))
    counts = {k: sum((low.rlike(p).cast("int") for p in ps), F.lit(0)) for k, ps in INTENTS.items()}
    best = F.greatest(*counts.values())
    out = F.when(best == 0, "general")
    for k, c in counts.items():
        out = out.when(c == best, k)
    return out


def grounding(answers: DataFrame, least: float = 0.15) -> DataFrame:
    """answers(id, answer, evidence) -> (id, sentences, unsupported, grounded): a sentence is unsupported below `least` token overlap."""
    s = answers.select("id", F.array_distinct(tokens(F.col("evidence"))).alias("_e"), F.explode(F.split(F.trim(F.coalesce("answer", F.lit(""))), r"[.!?]\s+")).alias("_s"))
    t = s.select("id", "_e", F.array_distinct(tokens(F.col("_s"))).alias("_t")).where(F.size("_t") > 0)
    bad = (F.size(F.array_intersect("_t", "_e")) / F.size("_t")) < least
    return t.groupBy("id").agg(F.count("*").alias("sentences"), F.count_if(bad).alias("unsupported")).withColumn("grounded", F.col("unsupported") == 0)


def pack_context(ranked: DataFrame, budget: int = 1700) -> DataFrame:
    """ranked(query_id, rank, id, document), few rows a query -> the rows kept: in rank order, skipping what doesn't fit and equal (id, document)."""
    first = ranked.withColumn("_d", F.row_number().over(Window.partitionBy("query_id", "id", "document").orderBy("rank"))).where(F.col("_d") == 1)
    rows = first.select("query_id", F.struct("rank", "id", token_estimate(F.col("document")).alias("cost")).alias("r")).groupBy("query_id").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    kept = F.aggregate(
        "rows",
        F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<rank:int,id:string,cost:int>>").alias("kept")),
        lambda s, r: F.when(s["used"] + r["cost"] <= budget, F.struct((s["used"] + r["cost"]).alias("used"), F.concat(s["kept"], F.array(F.struct(r["rank"].cast("int").alias("rank"), r["id"].cast("string").alias("id"), r["cost"].alias("cost")))).alias("kept"))).otherwise(s),
    )
    return rows.select("query_id", F.explode(kept["kept"]).alias("k")).select("query_id", "k.*")


def answer_cost(tokens_in: Column, tokens_out: Column) -> Column:
    return F.round(tokens_in / 1e6 * 0.2 + tokens_out / 1e6 * 0.6, 8)
