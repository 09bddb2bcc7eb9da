"""Queries over sources and sinks: what is written and read again, upserted, indexed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codestrata.functions import text as X
from codestrata.operators import retrieval as T
from codestrata.operators.records import current_records
from codestrata.plans.tables import CURRENT_SQL, table
from codestrata.session import ensure_checkpoint_dir
from codestrata.sources import files as S


def source_upsert(spark, sf_dir):
    """Commits known before the middle of the time of their arrival, with those that came later upserted by hash."""
    us = F.unix_micros(F.col("ingested_at").cast("timestamp"))
    c = table(spark, sf_dir, "commits").where(F.col("commit_hash").isNotNull() & F.col("ingested_at").isNotNull()).select("commit_hash", "author_email", "message", us.alias("us"))
    half = c.agg(((F.min("us") + F.max("us")) / 2).alias("_half"))  # one row
    c = c.join(F.broadcast(half))
    old, new = c.where(F.col("us") <= F.col("_half")).drop("_half"), c.where(F.col("us") > F.col("_half")).drop("_half")
    empty = spark.createDataFrame([], old.schema)
    return S.upsert(S.upsert(empty, old, ["commit_hash"], ["us"]), new, ["commit_hash"], ["us"]).select("commit_hash", "us")


def source_entities_round_trip(spark, sf_dir):
    """Entities written as JSON and read with the fixed schema: counts and sums by type."""
    g = table(spark, sf_dir, "repo_graph")
    out = f"{ensure_checkpoint_dir(spark)}/entities-{uuid.uuid4().hex}"
    S.write_entities(g.select(F.col("entity_type").alias("type"), "name", "unique_id", "file", F.col("line_range").alias("range"), "parameters", "complexity", "calls", "bases", "is_method"), out, "json")
    e = S.read_entities(spark, out, lines=True)
    return e.groupBy("type").agg(F.count("*").alias("n"), F.count("unique_id").alias("ids"), F.sum(F.size(F.coalesce("calls", F.array().cast("array<string>")))).alias("calls"), F.coalesce(F.sum("complexity.cyclomatic"), F.lit(0)).alias("cyclomatic"), F.sum(F.size(F.coalesce(F.col("parameters.name"), F.array().cast("array<string>")))).alias("parameters"), F.count("visibility").alias("visibility"))


def index_metadata(spark, sf_dir):
    """What an index holds of every entity beside its vector; entities without file or name aren't indexed."""
    r = current_records(table(spark, sf_dir, "repo_graph"), ["name", "entity_type", "line_range", "complexity", "is_method"])
    line = F.coalesce(F.try_element_at("line_range", F.lit(1)), F.lit(0))
    known = r.where((F.coalesce("file_path", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != ""))
    return known.select("uid", F.concat_ws(":", "file_path", "name", line.cast("string")).alias("vector_id"), F.col("file_path").alias("file"), F.col("entity_type").alias("type"), line.alias("line"), F.coalesce(F.col("complexity.cyclomatic"), F.lit(0)).alias("cyclomatic"))


def answer_costs(spark, sf_dir):
    q = table(spark, sf_dir, "questions")
    return q.select("id", T.answer_cost(T.token_estimate(F.col("query")), T.token_estimate(F.col("answer"))).alias("cost"))


def markup_html(spark, sf_dir):
    return table(spark, sf_dir, "questions").select("id", X.markup_to_html(F.concat(F.lit("## "), "query", F.lit("\n- **"), "category", F.lit("** & `"), "id", F.lit("`\n"), "answer")).alias("html"))


QUERIES = {f.__name__: f for f in (source_upsert, source_entities_round_trip, index_metadata, answer_costs, markup_html)}

_N = r"len(list_filter(regexp_split_to_array(coalesce({0}, ''), '\s+'), lambda w: w <> ''))"
_EST = f"(CASE WHEN {_N} = 0 THEN 0 ELSE greatest(1, floor({_N} * 1.25)) END)"


def _markup(text: str) -> str:
    for pattern, by in X.MARKUP:
        flags = ", 'g'"
        multi = pattern.startswith("(?m)")
        by = by.replace("$1", "\\1").replace("$2", "\\2").replace("'", "''")
        text = f"regexp_replace({text}, '{pattern.removeprefix('(?m)') if not multi else pattern}', '{by}'{flags})".replace("'\\n'", "chr(10)")
    return text


SQL = {
    "source_upsert": "SELECT commit_hash, epoch_us(max(ingested_at)) AS us FROM commits WHERE commit_hash IS NOT NULL AND ingested_at IS NOT NULL GROUP BY commit_hash",
    "source_entities_round_trip": "SELECT entity_type AS type, count(*) AS n, count(unique_id) AS ids, sum(coalesce(len(calls), 0))::BIGINT AS calls, coalesce(sum(complexity.cyclomatic), 0)::BIGINT AS cyclomatic, sum(coalesce(len(parameters), 0))::BIGINT AS parameters, 0::BIGINT AS visibility FROM repo_graph GROUP BY entity_type",
    "index_metadata": f"WITH {CURRENT_SQL} SELECT uid, fpath || ':' || name || ':' || coalesce(line_range[1], 0) AS vector_id, fpath AS file, entity_type AS type, coalesce(line_range[1], 0) AS line, coalesce(complexity.cyclomatic, 0) AS cyclomatic FROM cur WHERE fpath <> '' AND name <> ''",
    "answer_costs": f"SELECT id, round({_EST.format('query')} / 1e6 * 0.2::DOUBLE + {_EST.format('answer')} / 1e6 * 0.6::DOUBLE, 8) AS cost FROM questions",
    "markup_html": f"SELECT id, {_markup("('## ' || query || chr(10) || '- **' || category || '** & `' || id || '`' || chr(10) || answer)")} AS html FROM questions",
}
