"""Queries over the code graph of repo_graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.functions import risk
from codestrata.operators import graph as G
from codestrata.operators import rollup as R
from codestrata.operators.records import current_records
from codestrata.plans.tables import CURRENT_SQL, table
from codestrata.session import cut


def _entities(spark, sf_dir):
    return cut(current_records(table(spark, sf_dir, "repo_graph"), ["ordinal", "entity_type", "name", "calls", "bases", "complexity", "line_range"]))


def _graph(spark, sf_dir):
    entities = _entities(spark, sf_dir)
    return entities, cut(G.dependency_edges(entities))


def _hub(edges):
    """The node with most callers, first by id, as one row."""
    return G.simple_edges(edges).groupBy(F.col("target").alias("node")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "node").limit(1).select("node")


def g_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[1].groupBy("source", "target", "type").agg(F.count("*").alias("n"))


def g_edge_type_counts(spark, sf_dir):
    return G.edge_type_counts(_graph(spark, sf_dir)[1])


def g_degree(spark, sf_dir):
    entities, edges = _graph(spark, sf_dir)
    d = G.degrees(G.graph_nodes(entities, edges), G.simple_edges(edges))
    return d.withColumn("level", risk.degree_level(F.col("in_degree") + F.col("out_degree")))


def g_stats(spark, sf_dir):
    entities, edges = _graph(spark, sf_dir)
    return G.graph_stats(G.graph_nodes(entities, edges), G.simple_edges(edges))


def g_top_in_degree(spark, sf_dir):
    edges = _graph(spark, sf_dir)[1]
    return G.simple_edges(edges).groupBy(F.col("target").alias("node")).agg(F.count("*").alias("in_degree")).orderBy(F.col("in_degree").desc(), "node").limit(5)


def g_callers(spark, sf_dir):
    edges = _graph(spark, sf_dir)[1]
    return edges.where(F.col("type") == "CALLS").groupBy(F.col("target").alias("callee"), F.col("source").alias("caller")).agg(F.count("*").alias("calls"))


def g_subclasses(spark, sf_dir):
    return _graph(spark, sf_dir)[1].where(F.col("type") == "INHERITS").groupBy(F.col("target").alias("base")).agg(F.count_distinct("source").alias("subclasses"))


def g_ancestors_one(spark, sf_dir):
    edges = _graph(spark, sf_dir)[1]
    return G.reach(edges, _hub(edges)).select("seed", "node", "hops")


def g_affected_by_type(spark, sf_dir):
    edges = _graph(spark, sf_dir)[1]
    return G.affected_by_type(edges, cut(_hub(edges)))


def g_neighbourhood(spark, sf_dir):
    edges = _graph(spark, sf_dir)[1]
    return G.bounded_neighbourhood(edges, _hub(edges))


def g_inheritance_tree(spark, sf_dir):
    return G.inheritance_tree(_graph(spark, sf_dir)[1])


def g_inheritance_chain(spark, sf_dir):
    entities, edges = _graph(spark, sf_dir)
    return G.inheritance_chain(edges, entities.where(F.col("entity_type") == "class").select(F.col("uid").alias("node")))


def g_cycles_inheritance(spark, sf_dir):
    return G.simple_cycles(_graph(spark, sf_dir)[1].where(F.col("type") == "INHERITS"))


def _rolled(spark, sf_dir):
    entities, edges = _graph(spark, sf_dir)
    return cut(R.rollup_entities(entities, edges)), edges


def rollup_entities(spark, sf_dir):
    return _rolled(spark, sf_dir)[0].select("id", "name", "file", "directory", "risk_level", "complexity", "degree", "line")


def rollup_files(spark, sf_dir):
    return R.rollup_files(_rolled(spark, sf_dir)[0])


def rollup_directories(spark, sf_dir):
    return R.rollup_directories(R.rollup_files(_rolled(spark, sf_dir)[0]))


def rollup_file_edges(spark, sf_dir):
    return R.rollup_edges(*_rolled(spark, sf_dir), "file")


def rollup_directory_edges(spark, sf_dir):
    return R.rollup_edges(*_rolled(spark, sf_dir), "directory")


QUERIES = {f.__name__: f for f in (g_edges, g_edge_type_counts, g_degree, g_stats, g_top_in_degree, g_callers, g_subclasses, g_ancestors_one, g_affected_by_type, g_neighbourhood, g_inheritance_tree, g_inheritance_chain, g_cycles_inheritance, rollup_entities, rollup_files, rollup_directories, rollup_file_edges, rollup_directory_edges)}

_EDGES = CURRENT_SQL + r""",
names AS (SELECT name, min(ordinal) AS at, arg_min(uid, ordinal) AS target FROM cur WHERE name IS NOT NULL AND name <> '' GROUP BY name),
calls AS (SELECT uid, ordinal, call FROM (SELECT uid, ordinal, unnest(calls) AS call FROM cur WHERE entity_type = 'function') WHERE call IS NOT NULL AND call <> ''),
dc AS (SELECT DISTINCT call, split_part(call, '(', 1) AS text, split_part(split_part(call, '(', 1), '.', -1) AS name FROM calls),
ex AS (SELECT dc.call, dc.text, n.target FROM dc LEFT JOIN names n ON dc.name = n.name),
sfx AS (SELECT e.call, arg_min(n.target, n.at) AS target FROM (SELECT * FROM ex WHERE target IS NULL) e JOIN names n ON ends_with(e.text, n.name) GROUP BY e.call),
res AS (SELECT call, target FROM ex WHERE target IS NOT NULL UNION ALL SELECT call, target FROM sfx),
bases_ AS (SELECT uid, ordinal, base FROM (SELECT uid, ordinal, unnest(bases) AS base FROM cur WHERE entity_type = 'class') WHERE base IS NOT NULL AND base <> ''),
edges AS (SELECT uid AS source, target, 'CALLS' AS type, ordinal FROM calls JOIN res USING (call)
  UNION ALL SELECT uid, coalesce(n.target, b.base), 'INHERITS', b.ordinal FROM bases_ b LEFT JOIN names n ON b.base = n.name),
se AS (SELECT source, target, arg_max(type, ordinal) AS type FROM edges GROUP BY ALL),
nodes AS (SELECT uid AS node FROM cur UNION SELECT source FROM edges UNION SELECT target FROM edges),
hub AS (SELECT target AS node FROM se GROUP BY target ORDER BY count(*) DESC, target LIMIT 1)"""
_DEG = """deg AS (SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT source AS node, 0 AS i, 1 AS o FROM se UNION ALL SELECT target, 1, 0 FROM se UNION ALL SELECT node, 0, 0 FROM nodes) GROUP BY node)"""
_LEVEL = "CASE WHEN {0} >= 8 THEN 'CRITICAL' WHEN {0} >= 5 THEN 'HIGH' WHEN {0} >= 2 THEN 'MEDIUM' ELSE 'LOW' END"
_UP = "up AS (SELECT h.node AS seed, e.source AS node FROM hub h JOIN edges e ON e.target = h.node UNION SELECT up.seed, e.source FROM up JOIN edges e ON e.target = up.node)"
_ROLLED = _EDGES + r""",
d AS (SELECT uid, count(*) AS degree FROM (SELECT source AS uid FROM edges UNION ALL SELECT target FROM edges) GROUP BY uid),
ent AS (SELECT uid AS id, name, line_range[1] AS line, regexp_replace(fpath, '^[./]+', '') AS file, list_filter(string_split(regexp_replace(fpath, '^[./]+', ''), '/'), lambda x: x <> '') AS seg, coalesce(complexity.cyclomatic, 0) AS complexity, coalesce(d.degree, 0) AS degree
  FROM cur LEFT JOIN d USING (uid) WHERE fpath IS NOT NULL AND fpath <> ''),
roll AS (SELECT id, name, line, file, CASE len(seg) WHEN 0 THEN '' WHEN 1 THEN 'root' WHEN 2 THEN seg[1] ELSE seg[1] || '/' || seg[2] END AS directory, """ + _LEVEL.format("degree") + r""" AS risk_level, complexity, degree FROM ent),
files AS (SELECT file, directory, count(*) AS entity_count, arg_max(risk_level, list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], risk_level)) AS risk_level, sum(complexity)::BIGINT AS total_complexity FROM roll GROUP BY file, directory)"""

SQL = {
    "g_edges": f"WITH {_EDGES} SELECT source, target, type, count(*) AS n FROM edges GROUP BY ALL",
    "g_edge_type_counts": f"WITH {_EDGES} SELECT coalesce(type, 'total') AS type, count(*) AS n FROM edges GROUP BY ROLLUP (type)",
    "g_degree": f"WITH {_EDGES}, {_DEG} SELECT *, {_LEVEL.format('(in_degree + out_degree)')} AS level FROM deg",
    "g_stats": f"WITH {_EDGES}, c AS (SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM se) AS edges) SELECT nodes, edges, round(CASE WHEN nodes > 1 THEN edges / (nodes * (nodes - 1)) ELSE 0 END, 9) AS density FROM c",
    "g_top_in_degree": f"WITH {_EDGES} SELECT target AS node, count(*) AS in_degree FROM se GROUP BY target ORDER BY count(*) DESC, target LIMIT 5",
    "g_callers": f"WITH {_EDGES} SELECT target AS callee, source AS caller, count(*) AS calls FROM edges WHERE type = 'CALLS' GROUP BY ALL",
    "g_subclasses": f"WITH {_EDGES} SELECT target AS base, count(DISTINCT source) AS subclasses FROM edges WHERE type = 'INHERITS' GROUP BY target",
    "g_ancestors_one": f"""WITH RECURSIVE {_EDGES}, bfs AS (SELECT node AS seed, node, 0 AS hops FROM hub UNION SELECT b.seed, e.source, b.hops + 1 FROM bfs b JOIN (SELECT DISTINCT source, target FROM edges) e ON e.target = b.node WHERE b.hops < 12)
SELECT seed, node, min(hops)::INT AS hops FROM bfs WHERE node <> seed GROUP BY seed, node""",
    "g_affected_by_type": f"""WITH RECURSIVE {_EDGES}, {_UP}, u AS (SELECT seed, node FROM up WHERE node <> seed), inside AS (SELECT * FROM u UNION SELECT node, node FROM hub)
SELECT i.seed, count(DISTINCT CASE WHEN e.type = 'CALLS' THEN e.source END) AS callers, count(DISTINCT CASE WHEN e.type = 'INHERITS' THEN e.source END) AS inheritors, count(DISTINCT CASE WHEN e.type = 'USES_TYPE' THEN e.source END) AS type_users
FROM edges e JOIN inside i ON e.target = i.node JOIN u ON u.seed = i.seed AND u.node = e.source GROUP BY i.seed""",
    "g_cycles_inheritance": f"""WITH {_EDGES}, i AS (SELECT DISTINCT source, target FROM edges WHERE type = 'INHERITS'),
c1 AS (SELECT source AS cycle, 1 AS length FROM i WHERE source = target), n AS (SELECT * FROM i WHERE source <> target),
c2 AS (SELECT a.source || ' > ' || b.source, 2 FROM n a JOIN n b ON a.target = b.source AND b.target = a.source WHERE a.source < b.source),
c3 AS (SELECT a.source || ' > ' || b.source || ' > ' || c.source, 3 FROM n a JOIN n b ON a.target = b.source JOIN n c ON b.target = c.source AND c.target = a.source WHERE a.source < b.source AND a.source < c.source AND b.source <> c.source),
c4 AS (SELECT a.source || ' > ' || b.source || ' > ' || c.source || ' > ' || d.source, 4 FROM n a JOIN n b ON a.target = b.source JOIN n c ON b.target = c.source JOIN n d ON c.target = d.source AND d.target = a.source
  WHERE a.source < b.source AND a.source < c.source AND a.source < d.source AND b.source <> c.source AND b.source <> d.source AND c.source <> d.source)
SELECT * FROM c1 UNION SELECT * FROM c2 UNION SELECT * FROM c3 UNION SELECT * FROM c4""",
    "rollup_entities": f"WITH {_ROLLED} SELECT id, name, file, directory, risk_level, complexity, degree, line FROM roll",
    "rollup_files": f"WITH {_ROLLED} SELECT * FROM files",
    "rollup_directories": f"WITH {_ROLLED} SELECT directory, count(*) AS file_count, sum(entity_count)::BIGINT AS entity_count, arg_max(risk_level, list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], risk_level)) AS risk_level, sum(total_complexity)::BIGINT AS total_complexity FROM files GROUP BY directory",
    "rollup_file_edges": f"WITH {_ROLLED} SELECT s.file AS from_file, t.file AS to_file, count(*) AS weight FROM edges e JOIN roll s ON e.source = s.id JOIN roll t ON e.target = t.id WHERE s.file <> t.file GROUP BY ALL",
    "rollup_directory_edges": f"WITH {_ROLLED} SELECT s.directory AS from_directory, t.directory AS to_directory, count(*) AS weight FROM edges e JOIN roll s ON e.source = s.id JOIN roll t ON e.target = t.id WHERE s.directory <> t.directory GROUP BY ALL",
    "g_inheritance_tree": f"WITH {_EDGES}, i AS (SELECT DISTINCT source, target FROM edges WHERE type = 'INHERITS') SELECT source AS node, 'base' AS way, target AS other FROM i UNION ALL SELECT target, 'subclass', source FROM i",
    "g_inheritance_chain": f"""WITH RECURSIVE {_EDGES}, i AS (SELECT source, target, min(ordinal) AS o FROM edges WHERE type = 'INHERITS' GROUP BY ALL), f AS (SELECT source, arg_min(target, (o, target)) AS first FROM i GROUP BY source),
r AS (SELECT uid AS seed, uid AS at, [uid] AS seen, 1 AS step FROM cur WHERE entity_type = 'class' UNION ALL SELECT r.seed, f.first, list_append(r.seen, f.first), r.step + 1 FROM r JOIN f ON f.source = r.at WHERE NOT list_contains(r.seen, f.first))
SELECT r.seed, i.target AS ancestor, r.step FROM r JOIN i ON i.source = r.at""",
    "g_neighbourhood": f"""WITH {_EDGES}, one AS (SELECT DISTINCT target AS node, source AS nx, 0 AS way FROM edges WHERE source <> target UNION SELECT source, target, 1 FROM edges WHERE source <> target),
near AS (SELECT node, nx, way * 6 + k AS k FROM (SELECT *, row_number() OVER (PARTITION BY node, way ORDER BY nx) AS k FROM one) WHERE k <= 6),
h1 AS (SELECT h.node AS seed, n.nx AS node, min(lpad(k::VARCHAR, 3, '0')) AS met FROM hub h JOIN near n ON n.node = h.node GROUP BY ALL),
h2 AS (SELECT h.seed, n.nx AS node, min(h.met || lpad(k::VARCHAR, 3, '0')) AS met FROM h1 h JOIN near n ON n.node = h.node WHERE n.nx <> h.seed AND n.nx NOT IN (SELECT node FROM h1) GROUP BY ALL),
x AS (SELECT seed, node, 1 AS hop, met FROM h1 UNION ALL SELECT seed, node, 2, met FROM h2)
SELECT seed, node, hop FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hop, met, node) AS k FROM x) WHERE k <= 20""",
}
