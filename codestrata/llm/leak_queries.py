"""Queries over leaked evaluation texts (p8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.llm.leakage import leaked_items
from codestrata.plans.tables import table


def p8_leaks(spark, sf_dir):
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "questions"), ["query", "answer"], answer="answer")


def p8_found(spark, sf_dir):
    return p8_leaks(spark, sf_dir).where(F.col("kind") == "run").select("doc_id", "item_id")


QUERIES = {"p8_found": p8_found, "p8_leaks": p8_leaks}

SQL: dict[str, str] = {}
