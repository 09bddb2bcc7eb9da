"""Queries over packed texts (p7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.llm.packing import fill_report, pack, token_sizes
from codestrata.plans.tables import table
from codestrata.session import cut


#: Limits of a container beside its tokens: one segment for each 64 tokens, loss on 98 % of the tokens. On sf0.1 texts bear
#: loss on 95.9 % of their tokens, nine of ten on all, so both limits act.
TOKENS_PER_SEGMENT, LOSS_SHARE = 64, 0.98
MOST_CAPACITIES = 1000


def p7_containers(spark, sf_dir):
    budgets = table(spark, sf_dir, "prompt_budgets").select("capacity_tokens").where(F.col("capacity_tokens") > 0).distinct().limit(MOST_CAPACITIES + 1).collect()  # a fixed table
    if len(budgets) > MOST_CAPACITIES:
        raise ValueError(f"more than {MOST_CAPACITIES} capacities")
    sizes = cut(token_sizes(table(spark, sf_dir, "documents")))
    return pack(sizes, [r[0] for r in budgets], TOKENS_PER_SEGMENT, LOSS_SHARE)


def p7_fill(spark, sf_dir):
    return fill_report(p7_containers(spark, sf_dir))


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill}

SQL: dict[str, str] = {}
