"""Queries over functions and their documentation (p4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.llm.docpairs import documented_functions, symbol_table
from codestrata.operators.records import current_records
from codestrata.plans.tables import CURRENT_SQL, table


def _functions(spark, sf_dir):
    g = table(spark, sf_dir, "repo_graph").withColumn("parameters", F.transform("parameters", lambda p: F.struct(p["name"].alias("name"), p["type_hint"].alias("type_hint"))))
    r = current_records(g, ["entity_type", "name", "parent_class", "signature", "docstring", "parameters", "return_type"])
    return r.where(F.col("entity_type") == "function")


def p4_pairs(spark, sf_dir):
    return documented_functions(_functions(spark, sf_dir))


def p4_found(spark, sf_dir):
    return p4_pairs(spark, sf_dir).where(F.col("doc_source") == "own").select("unique_id")


def p4_symbols(spark, sf_dir):
    """Overloads of the symbol table: how many functions share one, how many of them carry a docstring, the first with one."""
    t = symbol_table(_functions(spark, sf_dir))
    documented = F.when(F.col("own").isNotNull(), F.col("uid"))
    return t.groupBy("symbol", "overload").agg(F.count("*").alias("functions"), F.count(documented).alias("documented"), F.min(documented).alias("first_documented"))


QUERIES = {"p4_found": p4_found, "p4_pairs": p4_pairs, "p4_symbols": p4_symbols}

_SIGNATURE = r"""regexp_replace(lower(signature), '\s+', ' ', 'g')"""
_MODIFIERS = rf"""regexp_replace({_SIGNATURE}, '^(?:async |def |public |private |protected |static |final |virtual |inline |override )+', '')"""
_DEFAULTS = rf"""regexp_replace({_MODIFIERS}, '\s*=\s*(?:''[^'']*''|"[^"]*"|[^,()]*(?:\([^()]*\))?)([,)])', '\1', 'g')"""

SQL = {
    "p4_symbols": rf"""WITH {CURRENT_SQL},
f AS (SELECT uid, signature, docstring, coalesce(repo, '') || CASE WHEN parent_class IS NULL OR parent_class = '' THEN '' ELSE '.' || parent_class END || '.' || coalesce(name, '') AS symbol
  FROM cur WHERE entity_type = 'function' AND trim(regexp_replace(signature, '\s+', ' ', 'g')) <> ''),
s AS (SELECT symbol, regexp_replace(regexp_replace({_DEFAULTS}, '\)\s*(?:->.*|:.*|const.*|throws.*)$', ')'), '\s+', '', 'g') AS overload,
  CASE WHEN trim(regexp_replace(docstring, '\s+', ' ', 'g')) <> '' THEN uid END AS documented FROM f)
SELECT symbol, overload, count(*) AS functions, count(documented) AS documented, min(documented) AS first_documented FROM s GROUP BY symbol, overload""",
}
