"""Queries of the general problems: nested records (p1) and hierarchies (p3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.operators.class_tree import parent_links
from codestrata.operators.hierarchy import hierarchy
from codestrata.operators.shred import child_links, shred_nodes, variant_tables
from codestrata.plans.tables import CURRENT_SQL, table


def _tables(spark, sf_dir):
    return variant_tables(shred_nodes(table(spark, sf_dir, "graph_dumps")))


def p1_found(spark, sf_dir):
    return child_links(_tables(spark, sf_dir))


def p1_functions(spark, sf_dir):
    return _tables(spark, sf_dir)["functions"].drop("shape")


def p1_variants(spark, sf_dir):
    """How many rows of each typed table have each structural variant, and in how many dumps."""
    tables = _tables(spark, sf_dir)
    parts = [tables[t].select(F.lit(t).alias("table"), "shape", "dump_id") for t in ("functions", "classes", "parameters", "calls", "complexity")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("table", "shape").agg(F.count("*").alias("n"), F.count_distinct("dump_id").alias("dumps"))


def p3_found(spark, sf_dir):
    return hierarchy(parent_links(table(spark, sf_dir, "repo_graph")))


QUERIES = {"p1_found": p1_found, "p1_functions": p1_functions, "p1_variants": p1_variants, "p3_found": p3_found}

SQL = {
    "p3_found": rf"""WITH RECURSIVE {CURRENT_SQL},
nodes AS (SELECT uid, repo, name, entity_type, bases, parent_class FROM cur
  WHERE entity_type = 'class' OR (entity_type = 'function' AND parent_class IS NOT NULL)),
named AS (SELECT repo, name AS ref, min(uid) AS parent FROM nodes WHERE entity_type = 'class' AND name IS NOT NULL GROUP BY ALL),
refs AS (
  SELECT repo, uid, 0 AS pos, parent_class AS ref FROM nodes WHERE entity_type = 'function'
  UNION ALL
  SELECT repo, uid, unnest(range(len(bases))) AS pos, trim(split_part(trim(split_part(unnest(bases), '[', 1)), '.', -1)) AS ref FROM nodes WHERE entity_type = 'class'),
links AS (SELECT uid, arg_min(parent, pos) AS parent FROM refs JOIN named USING (repo, ref) GROUP BY uid),
par AS (SELECT n.uid AS node, n.name, l.parent FROM nodes n LEFT JOIN links l USING (uid)),
anc AS (SELECT node, parent AS a FROM par WHERE parent IS NOT NULL UNION SELECT anc.node, par.parent FROM anc JOIN par ON anc.a = par.node WHERE par.parent IS NOT NULL),
ring AS (SELECT node FROM anc WHERE node = a),
bad AS (SELECT DISTINCT node FROM anc WHERE a IN (SELECT node FROM ring)),
depth AS (SELECT p.node, p.name, p.parent, count(anc.a) AS d FROM par p LEFT JOIN anc ON p.node = anc.node GROUP BY ALL),
chain AS (SELECT node, a FROM anc UNION ALL SELECT node, node FROM par),
good AS (SELECT c.node, arg_min(c.a, x.d) AS root, max(x.d) AS depth, string_agg(coalesce(x.name, ''), '/' ORDER BY x.d) AS path
  FROM chain c JOIN depth x ON c.a = x.node WHERE c.node NOT IN (SELECT node FROM bad) GROUP BY c.node),
below AS (SELECT a AS node, count(*) AS n FROM anc WHERE node <> a GROUP BY a)
SELECT p.node, coalesce(g.root, '') AS root, coalesce(g.depth, -1)::INT AS depth, coalesce(g.path, '') AS path, coalesce(b.n, 0)::INT AS n_descendants,
  CASE WHEN p.node IN (SELECT node FROM ring) THEN 'cycle' WHEN p.node IN (SELECT node FROM bad) THEN 'below_cycle' ELSE 'tree' END AS state
FROM par p LEFT JOIN good g ON p.node = g.node LEFT JOIN below b ON p.node = b.node""",
}
