"""Queries over variant spellings of authors (p6)."""

from __future__ import annotations

from codestrata.llm.variants import identity_pairs, link_variants
from codestrata.plans.tables import table
from codestrata.session import cut


def p6_persons(spark, sf_dir):
    return link_variants(table(spark, sf_dir, "commits"), table(spark, sf_dir, "given_names"))


def p6_found(spark, sf_dir):
    return identity_pairs(cut(p6_persons(spark, sf_dir)))


QUERIES = {"p6_found": p6_found, "p6_persons": p6_persons}

SQL: dict[str, str] = {}
