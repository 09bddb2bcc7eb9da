"""Queries over blast radius, risks and the views of an impact."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.operators import graph as G
from codestrata.operators import history as H
from codestrata.operators import impact as I
from codestrata.operators import rollup as R
from codestrata.plans.graph_queries import _DEG, _EDGES, _LEVEL, _ROLLED, _graph, _rolled
from codestrata.plans.history_queries import _CHANGES, _changes
from codestrata.session import cut

#: The stated nodes that are asked about: those with most callers.
SEEDS = 20


def _seeds(edges, n=SEEDS):
    top = G.simple_edges(edges).groupBy(F.col("target").alias("node")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "node").limit(n)
    return cut(top.select("node"))


def g_centrality(spark, sf_dir):
    return G.betweenness(_graph(spark, sf_dir)[1])


def g_impact(spark, sf_dir):
    entities, edges = _graph(spark, sf_dir)
    rows = I.impact(edges, entities, _seeds(edges), cut(G.betweenness(edges)), H.file_risk(_changes(spark, sf_dir)))
    functions = entities.where(F.col("entity_type") == "function").agg(F.count("*").alias("_functions"))  # one row
    return I.blast_share(rows.join(F.broadcast(functions)), F.col("_functions")).drop("_functions")


def g_dependents(spark, sf_dir):
    return G.dependents(_graph(spark, sf_dir)[1])


def g_dependencies(spark, sf_dir):
    return G.dependents(_graph(spark, sf_dir)[1], upstream=False)


def g_callees(spark, sf_dir):
    edges = _graph(spark, sf_dir)[1].where(F.col("type") == "CALLS")
    return edges.groupBy(F.col("source").alias("caller"), F.col("target").alias("callee")).agg(F.count("*").alias("calls"))


def g_descendants(spark, sf_dir):
    edges = _graph(spark, sf_dir)[1]
    return G.reach(edges, _seeds(edges), upstream=False)


def g_ancestors(spark, sf_dir):
    edges = _graph(spark, sf_dir)[1]
    return G.reach(edges, _seeds(edges))


def g_subgraph_nodes(spark, sf_dir):
    edges = _graph(spark, sf_dir)[1]
    return I.induced_subgraph(edges, _seeds(edges))[0].drop("hops")


def g_subgraph_edges(spark, sf_dir):
    edges = _graph(spark, sf_dir)[1]
    return I.induced_subgraph(edges, _seeds(edges))[1]


def g_neighbours(spark, sf_dir):
    edges = _graph(spark, sf_dir)[1]
    return I.neighbours(edges, _seeds(edges))


def _tree(spark, sf_dir):
    entities, edges = _graph(spark, sf_dir)
    return I.impact_tree(edges, entities, _seeds(edges))


def g_tree_paths(spark, sf_dir):
    return _tree(spark, sf_dir)["paths"]


def g_tree_shown(spark, sf_dir):
    return _tree(spark, sf_dir)["shown"]


def g_tree_edges(spark, sf_dir):
    return _tree(spark, sf_dir)["edges"]


def g_node_view(spark, sf_dir):
    entities, edges = _graph(spark, sf_dir)
    return I.node_view(G.graph_nodes(entities, edges), edges, entities)


def g_edge_view(spark, sf_dir):
    entities, edges = _graph(spark, sf_dir)
    return I.edge_view(edges, I.node_view(G.graph_nodes(entities, edges), edges, entities))


def g_visible_edges(spark, sf_dir):
    """Edges between what is seen with the directories of most entities open, and in them the files of most entities."""
    rolled, edges = _rolled(spark, sf_dir)
    files = R.rollup_files(rolled)
    opened = R.rollup_directories(files).orderBy(F.col("entity_count").desc(), "directory").limit(5)
    return I.visible_edges(edges, rolled, opened, files.orderBy(F.col("entity_count").desc(), "file").limit(5))


def g_summary(spark, sf_dir):
    """(files, classes, functions, nodes, edges): the size of the graph."""
    entities, edges = _graph(spark, sf_dir)
    of = lambda t: F.count_if(F.col("entity_type") == t)
    counts = entities.agg(F.count_distinct("file_path").alias("files"), of("class").alias("classes"), of("function").alias("functions"))
    return counts.join(G.graph_stats(G.graph_nodes(entities, edges), G.simple_edges(edges)))  # one row each


QUERIES = {f.__name__: f for f in (g_centrality, g_impact, g_dependents, g_dependencies, g_callees, g_descendants, g_ancestors, g_subgraph_nodes, g_subgraph_edges, g_neighbours, g_tree_paths, g_tree_shown, g_tree_edges, g_node_view, g_edge_view, g_visible_edges, g_summary)}

#: The SQL follows paths of at most so many hops; the test data's are shorter.
_HOPS = 30
_SEEDS = f"seeds AS (SELECT target AS node FROM se GROUP BY target ORDER BY count(*) DESC, target LIMIT {SEEDS}), st AS (SELECT DISTINCT source, target FROM edges WHERE source <> target)"


def _reach(name: str, near: str, far: str, hops: int = _HOPS) -> str:
    return f"""{name}_ AS (SELECT node AS seed, node, 0 AS hops FROM seeds UNION SELECT b.seed, e.{far}, b.hops + 1 FROM {name}_ b JOIN st e ON e.{near} = b.node WHERE b.hops < {hops}),
{name} AS (SELECT seed, node, min(hops)::INT AS hops FROM {name}_ GROUP BY seed, node)"""


_UP = _reach("up", "target", "source")
_INSIDE = f"{_SEEDS}, {_UP}, pairs AS (SELECT t.seed, e.source, e.target, count(*) AS n FROM edges e JOIN up t ON t.node = e.target JOIN up s ON s.seed = t.seed AND s.node = e.source GROUP BY ALL)"
_BETWEEN = f"""wst AS (SELECT DISTINCT source, target FROM edges WHERE source <> target),
b_ AS (SELECT source AS s, source AS v, 0 AS d FROM (SELECT DISTINCT source FROM wst) UNION SELECT b.s, e.target, b.d + 1 FROM b_ b JOIN wst e ON e.source = b.v WHERE b.d < {_HOPS}),
bd AS (SELECT s, v, min(d) AS d FROM b_ GROUP BY s, v),
bp AS (SELECT s, v, d FROM bd WHERE d = 0 UNION ALL SELECT p.s, x.v, x.d FROM bp p JOIN wst e ON e.source = p.v JOIN bd x ON x.s = p.s AND x.v = e.target AND x.d = p.d + 1),
bs AS (SELECT s, v, any_value(d) AS d, count(*)::DOUBLE AS c FROM bp GROUP BY s, v),
bb AS (SELECT a.v, sum(a.c * b.c / t.c) AS b FROM bs a JOIN bs b ON b.s = a.v JOIN bs t ON t.s = a.s AND t.v = b.v WHERE a.s <> a.v AND b.v <> a.v AND b.v <> a.s AND a.d + b.d = t.d GROUP BY a.v),
between_ AS (SELECT n.node, round(coalesce(bb.b, 0.0), 6) AS betweenness FROM (SELECT source AS node FROM edges UNION SELECT target FROM edges) n LEFT JOIN bb ON bb.v = n.node)"""
_FILE_RISK = """fx AS (SELECT *, floor((epoch_us((SELECT max(ts) FROM ch)) - epoch_us(ts)) / 86400000000)::BIGINT AS age FROM ch),
fg AS (SELECT file, count(*) AS n, count(DISTINCT email) AS authors, count(*) FILTER (age <= 90) / count(*) AS recent FROM fx GROUP BY file),
fr AS (SELECT file, round(least(0.6::DOUBLE * least(n / greatest((SELECT max(n) FROM fg), 1), 1.0) + 0.4::DOUBLE * recent, 1.0), 6) AS change_risk, CASE WHEN authors <= 1 THEN 1.0 WHEN authors = 2 THEN 0.7 WHEN authors = 3 THEN 0.4 WHEN authors = 4 THEN 0.2 ELSE 0.1 END::DOUBLE AS bus_risk FROM fg)"""
_NODE = f"""{_DEG}, nv AS (SELECT d.node, coalesce(c.entity_type, CASE WHEN contains(split_part(d.node, ':', -1), '.') OR regexp_matches(split_part(d.node, ':', -1), '^[A-Z]') THEN 'class' ELSE 'function' END) AS type, in_degree, out_degree, {_LEVEL.format("(in_degree + out_degree)")} AS level,
  least((in_degree + out_degree) / 10, 1.0)::DOUBLE AS connectivity, least(out_degree / 15, 1.0)::DOUBLE AS complexity FROM deg d LEFT JOIN cur c ON c.uid = d.node)"""
_TREE = f"""{_SEEDS}, {_reach("hit_", "target", "source", 3)}, hits AS (SELECT h.seed, h.node, h.hops, c.fpath AS file FROM hit_ h JOIN cur c ON c.uid = h.node WHERE h.node <> h.seed AND c.fpath IS NOT NULL),
tf AS (SELECT seed, file FROM (SELECT seed, file, row_number() OVER (PARTITION BY seed ORDER BY count(*) DESC, file) AS k FROM hits GROUP BY seed, file) WHERE k <= 20),
shown AS (SELECT * FROM (SELECT h.seed, h.file, h.node, h.hops, row_number() OVER (PARTITION BY h.seed, h.file ORDER BY h.hops, h.node)::INT AS place FROM hits h JOIN tf USING (seed, file)) WHERE place <= 8)"""
_RISK_NAMES = {"c": "complexity", "ce": "centrality", "t": "test", "dep": "dependency", "ch": "change", "bu": "bus"}
_TOP = ", ".join(f"CASE WHEN round({k}, 6) >= 0.5 THEN '{v} (' || round(round({k}, 6) * 100, 0)::INT || ' %)' END" for k, v in _RISK_NAMES.items())
_PANEL = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), '; ')"

SQL = {
    "g_centrality": f"WITH RECURSIVE {_EDGES}, {_BETWEEN} SELECT * FROM between_",
    "g_impact": f"""WITH RECURSIVE {_EDGES}, {_CHANGES}, {_SEEDS}, {_UP}, {_BETWEEN}, {_FILE_RISK}, {_DEG},
x AS (SELECT s.node, (SELECT count(*) FROM up WHERE seed = s.node AND node <> s.node) AS blast_radius, (SELECT count(*) FROM se WHERE target = s.node AND source <> s.node AND type = 'CALLS') AS direct,
  (SELECT count(*) FROM up WHERE seed = s.node AND node <> s.node AND contains(lower(node), 'test')) AS tests, coalesce((SELECT max(hops) FROM up WHERE seed = s.node AND node <> s.node), 0) AS depth, d.in_degree + d.out_degree AS degree,
  c.fpath, c.complexity.cyclomatic AS cyc, c.complexity.cognitive AS cog, fr.change_risk, fr.bus_risk, b.betweenness AS bet FROM seeds s LEFT JOIN cur c ON c.uid = s.node LEFT JOIN deg d ON d.node = s.node LEFT JOIN fr ON fr.file = c.fpath LEFT JOIN between_ b ON b.node = s.node),
y AS (SELECT *, least((coalesce(cyc, 0) + coalesce(cog, 0) / 2) / 15, 1.0)::DOUBLE AS c, coalesce(bet / nullif((SELECT max(betweenness) FROM between_), 0), 0.0)::DOUBLE AS ce, CASE WHEN tests = 0 THEN 1.0 ELSE greatest(0.0, 1 - 0.3::DOUBLE * tests) END::DOUBLE AS t, least(blast_radius / 10, 1.0)::DOUBLE AS dep,
  CASE WHEN fpath <> '' THEN coalesce(change_risk, 0.3) ELSE least(degree / 20, 1.0) END::DOUBLE AS ch, CASE WHEN fpath <> '' THEN coalesce(bus_risk, 0.5) ELSE 0.5 END::DOUBLE AS bu FROM x),
z AS (SELECT *, least(c * 0.25::DOUBLE + ce * 0.2::DOUBLE + t * 0.2::DOUBLE + dep * 0.15::DOUBLE + ch * 0.1::DOUBLE + bu * 0.1::DOUBLE, 1.0) AS total, round(blast_radius / greatest((SELECT count(*) FROM cur WHERE entity_type = 'function'), 1) * 100, 4) AS share FROM y)
SELECT node, blast_radius, direct, blast_radius - direct AS indirect, tests, depth::INT AS depth, round(c, 6) AS complexity_risk, round(ce, 6) AS centrality_risk, round(t, 6) AS test_risk, round(dep, 6) AS dependency_risk, round(ch, 6) AS change_risk, round(bu, 6) AS bus_risk, round(total, 6) AS risk,
  CASE WHEN round(total, 9) < 0.2 THEN 'LOW' WHEN round(total, 9) < 0.5 THEN 'MEDIUM' WHEN round(total, 9) < 0.8 THEN 'HIGH' ELSE 'CRITICAL' END AS level, CASE WHEN blast_radius > 10 THEN 'HIGH' WHEN blast_radius > 5 THEN 'MODERATE' ELSE 'LOW' END AS band, round(total, 9) < 0.3 AS safe_to_change,
  {_PANEL.format(_TOP)} AS top_risks,
  coalesce(nullif({_PANEL.format("CASE WHEN round(c, 6) >= 0.7 THEN 'reduce complexity before changing this' END, CASE WHEN round(t, 6) >= 0.7 AND tests = 0 THEN 'add unit tests before changing this' END, CASE WHEN round(t, 6) >= 0.7 AND tests > 0 THEN 'add more tests' END, CASE WHEN round(ce, 6) >= 0.6 THEN 'on a critical path: changes spread widely' END, CASE WHEN round(dep, 6) >= 0.6 THEN 'many modules depend on this: tell their teams' END, CASE WHEN round(bu, 6) >= 0.7 THEN 'pair or review with a second developer' END")}, ''), 'risk is acceptable') AS advice,
  share, CASE WHEN share > 30 THEN 'very wide' WHEN share > 10 THEN 'wide' ELSE 'contained' END AS share_flag FROM z""",
    "g_dependents": f"WITH {_EDGES} SELECT DISTINCT target AS node, source AS other, type FROM edges",
    "g_dependencies": f"WITH {_EDGES} SELECT DISTINCT source AS node, target AS other, type FROM edges",
    "g_callees": f"WITH {_EDGES} SELECT source AS caller, target AS callee, count(*) AS calls FROM edges WHERE type = 'CALLS' GROUP BY ALL",
    "g_descendants": f"WITH RECURSIVE {_EDGES}, {_SEEDS}, {_reach('down', 'source', 'target')} SELECT seed, node, hops FROM down WHERE node <> seed",
    "g_ancestors": f"WITH RECURSIVE {_EDGES}, {_SEEDS}, {_UP} SELECT seed, node, hops FROM up WHERE node <> seed",
    "g_subgraph_nodes": f"""WITH RECURSIVE {_EDGES}, {_INSIDE}, r AS (SELECT seed, target, sum(n)::BIGINT AS refs FROM pairs GROUP BY ALL)
SELECT u.seed, u.node, coalesce(r.refs, 0) AS refs, CASE WHEN coalesce(r.refs, 0) >= 8 THEN 'high' WHEN coalesce(r.refs, 0) >= 3 THEN 'medium' ELSE 'low' END AS level FROM up u LEFT JOIN r ON r.seed = u.seed AND r.target = u.node""",
    "g_subgraph_edges": f"WITH RECURSIVE {_EDGES}, {_INSIDE} SELECT seed, source, target, n FROM pairs",
    "g_neighbours": f"WITH {_EDGES}, {_SEEDS} SELECT seed, node, way, count(*) AS n FROM (SELECT s.node AS seed, e.source AS node, 'in' AS way FROM edges e JOIN seeds s ON e.target = s.node UNION ALL SELECT s.node, e.target, 'out' FROM edges e JOIN seeds s ON e.source = s.node) GROUP BY ALL",
    "g_tree_paths": f"""WITH RECURSIVE {_EDGES}, {_SEEDS}, w AS (SELECT node AS seed, node, [node] AS path, 0 AS depth FROM seeds UNION ALL SELECT w.seed, st.source, list_append(w.path, st.source), w.depth + 1 FROM w JOIN st ON st.target = w.node WHERE w.depth < 3 AND NOT list_contains(w.path, st.source))
SELECT seed, array_to_string(path, ' < ') AS path, depth, node, CASE WHEN depth = 3 THEN (SELECT count(*) FROM st WHERE st.target = w.node) ELSE 0 END AS more FROM w""",
    "g_tree_shown": f"WITH RECURSIVE {_EDGES}, {_TREE} SELECT seed, file, node, hops, place FROM shown",
    "g_tree_edges": f"""WITH RECURSIVE {_EDGES}, {_TREE}, few AS (SELECT seed, node FROM shown UNION SELECT node, node FROM seeds)
SELECT seed, source, target FROM (SELECT t.seed, e.source, e.target, row_number() OVER (PARTITION BY t.seed ORDER BY e.source, e.target) AS k FROM se e JOIN few t ON t.node = e.target JOIN few s ON s.seed = t.seed AND s.node = e.source) WHERE k <= 30""",
    "g_node_view": f"WITH {_EDGES}, {_NODE} SELECT *, list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], level) / 4 AS weight FROM nv",
    "g_edge_view": f"WITH {_EDGES}, {_NODE} SELECT e.source, e.target, e.type, n.level FROM se e JOIN nv n ON n.node = e.target",
    "g_visible_edges": f"""WITH {_ROLLED}, od AS (SELECT directory FROM files GROUP BY directory ORDER BY sum(entity_count) DESC, directory LIMIT 5), op AS (SELECT file FROM files ORDER BY entity_count DESC, file LIMIT 5),
v AS (SELECT id, CASE WHEN directory NOT IN (SELECT directory FROM od) THEN directory WHEN file NOT IN (SELECT file FROM op) THEN file ELSE id END AS at FROM roll)
SELECT DISTINCT s.at AS from_node, t.at AS to_node FROM edges e JOIN v s ON s.id = e.source JOIN v t ON t.id = e.target WHERE s.at <> t.at""",
    "g_summary": f"""WITH {_EDGES}, c AS (SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM se) AS edges)
SELECT (SELECT count(DISTINCT fpath) FROM cur) AS files, (SELECT count(*) FROM cur WHERE entity_type = 'class') AS classes, (SELECT count(*) FROM cur WHERE entity_type = 'function') AS functions, nodes, edges, round(CASE WHEN nodes > 1 THEN edges / (nodes * (nodes - 1)) ELSE 0 END, 9) AS density FROM c""",
}
