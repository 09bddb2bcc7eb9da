"""Queries over repo_graph: term frequencies (p2) and the top functions of a file (p5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codestrata.llm.terms import term_frequencies
from codestrata.llm.topn import top_n_per_group
from codestrata.operators.records import current_records
from codestrata.plans.tables import CURRENT_SQL, table
from codestrata.session import cut


def call_term(c: Column) -> Column:
    """A called name without surrounding blanks and without one closing '()' and the blanks before it."""
    return F.regexp_replace(F.regexp_replace(c, r"^[ \t]+|[ \t]+\z", ""), r"[ \t]*\(\)\z", "")


def call_terms(spark, sf_dir):
    r = current_records(table(spark, sf_dir, "repo_graph"), ["entity_type", "calls"])
    terms = r.where(F.col("entity_type") == "function").select("uid", F.explode("calls").alias("call")).select("uid", call_term(F.col("call")).alias("term"))
    return terms.where(F.col("term").isNotNull() & (F.col("term") != ""))


def p2_found(spark, sf_dir):
    # Written once: the range partitioning samples its input, the count of functions reads it again.
    return term_frequencies(cut(call_terms(spark, sf_dir)), "uid", "term")


def p5_found(spark, sf_dir):
    r = current_records(table(spark, sf_dir, "repo_graph"), ["entity_type", "complexity"])
    f = r.where(F.col("entity_type") == "function").select("uid", "file_path", F.col("complexity.cyclomatic").alias("cyclomatic"))
    top = top_n_per_group(f, ["file_path"], "cyclomatic", ["uid"], 3)
    return top.select(F.col("file_path").alias("file"), "place", F.col("uid").alias("unique_id"))


QUERIES = {"p2_found": p2_found, "p5_found": p5_found}

SQL = {
    "p2_found": rf"""WITH {CURRENT_SQL},
calls AS (SELECT uid, unnest(calls) AS call FROM cur WHERE entity_type = 'function'),
terms AS (SELECT uid, regexp_replace(regexp_replace(call, '^[ \t]+|[ \t]+\z', '', 'g'), '[ \t]*\(\)\z', '') AS term FROM calls WHERE call IS NOT NULL),
t AS (SELECT * FROM terms WHERE term <> '')
SELECT term, count(*) AS occurrences, count(DISTINCT uid) AS records,
  CASE WHEN count(DISTINCT uid) <= 2 THEN 'rare' WHEN count(DISTINCT uid) > (SELECT count(DISTINCT uid) FROM t) * 0.05 THEN 'common' ELSE 'useful' END AS mark
FROM t GROUP BY term""",
    "p5_found": rf"""WITH {CURRENT_SQL}
SELECT file, place::INT AS place, unique_id FROM (
  SELECT fpath AS file, uid AS unique_id, row_number() OVER (PARTITION BY fpath ORDER BY complexity.cyclomatic DESC, uid) AS place
  FROM cur WHERE entity_type = 'function' AND complexity.cyclomatic IS NOT NULL)
WHERE place <= 3""",
}
