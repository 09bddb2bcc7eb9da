"""Evaluation of answers: per-question metrics, aggregates and the regression gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.operators.retrieval import tokens


def entity_recall(questions: DataFrame) -> DataFrame:
    """questions(id, expected_entities, answer, evidence) -> (id, recall): share of expected names found in the answer or evidence; none expected counts 0."""
    text = F.lower(F.concat_ws(" ", "answer", "evidence"))
    expected = F.array_distinct(F.filter(F.coalesce("expected_entities", F.array().cast("array<string>")), lambda e: e.isNotNull() & (e != "")))
    hit = F.size(F.filter(expected, lambda e: F.contains(text, F.lower(e))))
    return questions.select("id", F.when(F.size(expected) > 0, F.round(hit / F.size(expected), 6)).otherwise(0.0).alias("recall"))


def relevancy(questions: DataFrame) -> DataFrame:
    """(id, relevancy): share of the query's tokens of more than two letters that the answer holds."""
    long = lambda c: F.filter(F.array_distinct(tokens(F.col(c))), lambda t: F.length(t) > 2)
    q = long("query")
    return questions.select("id", F.when(F.size(q) > 0, F.round(F.size(F.array_intersect(q, long("answer"))) / F.size(q), 6)).otherwise(0.0).alias("relevancy"))


def faithfulness(grounded: DataFrame) -> DataFrame:
    score = F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), 0.34 * F.col("unsupported")))
    return grounded.select("id", F.round(F.when(F.col("grounded"), F.greatest(score, F.lit(0.8))).otherwise(score), 6).alias("faithfulness"))


def precision_at(ranked: DataFrame, questions: DataFrame, k: int = 4) -> DataFrame:
    """ranked(id, doc, name, file, rank) -> (id, precision): share of the first k hits whose name or file is expected; no hits count 0."""
    expected = questions.select("id", F.transform(F.coalesce("expected_entities", F.array().cast("array<string>")), lambda e: F.lower(e)).alias("_x"))
    hits = ranked.where(F.col("rank") <= k).join(expected, "id", "right")
    right = F.coalesce(F.array_contains("_x", F.lower("name")) | F.array_contains("_x", F.lower("file")), F.lit(False))
    return hits.groupBy("id").agg(F.round(F.coalesce(F.avg(F.when(F.col("rank").isNotNull(), right.cast("double"))), F.lit(0.0)), 6).alias("precision"))


def nearest_rank(df: DataFrame, by: list[str], value: str, share: float = 0.95) -> DataFrame:
    """The ceil(share n)-th value of every group, exactly."""
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.expr(f"percentile_disc({share}) within group (order by {value})").alias("p"))


def gate(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row each of (faithfulness, relevancy, precision, recall, p95_ms, cost) -> (status, failures, warnings); an unmeasured time warns of nothing."""
    d = current.join(baseline.select(*[F.col(c).alias("b_" + c) for c in baseline.columns]))
    drop = lambda c, by: F.round(F.col(c) - F.col("b_" + c), 9) < -by
    failures = drop("faithfulness", 0.02).cast("int") + drop("relevancy", 0.02).cast("int")
    slow = (F.col("p95_ms") > 4000) & (F.col("p95_ms") > F.col("b_p95_ms"))
    dear = (F.col("b_cost") > 0) & (F.col("cost") / F.nullif("b_cost", F.lit(0.0)) > 1.25)
    warnings = drop("precision", 0.03).cast("int") + drop("recall", 0.03).cast("int") + F.coalesce(slow, F.lit(False)).cast("int") + F.coalesce(dear, F.lit(False)).cast("int")
    return d.select(F.when(failures > 0, "fail").when(warnings > 0, "warn").otherwise("pass").alias("status"), failures.alias("failures"), warnings.alias("warnings"))


def judged(answers: DataFrame, judge, schema: str = "id string, score double") -> DataFrame:
    """answers(id, query, answer, evidence) with the scores of an injected judge(list of dicts) -> list of floats, called once a batch."""

    def run(batches):
        for pdf in batches:
            scores = judge(pdf.to_dict("records"))
            yield pdf[["id"]].assign(score=[float(x) for x in scores])

    return answers.select("id", "query", "answer", "evidence").mapInPandas(run, schema)
