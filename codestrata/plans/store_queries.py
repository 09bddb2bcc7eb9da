"""Queries over the graph store and text helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.functions import text as X
from codestrata.functions.paths import compared_path
from codestrata.operators import store as S
from codestrata.operators.graph import dependency_edges
from codestrata.operators.records import current_records
from codestrata.plans.graph_queries import _EDGES
from codestrata.plans.tables import table
from codestrata.session import cut


def _store(spark, sf_dir):
    """Every record is added in load order, older ones too; then the dependency edges of the current ones."""
    g = table(spark, sf_dir, "repo_graph").where(F.col("unique_id").isNotNull())
    attributes = F.map_filter(F.create_map(F.lit("type"), F.col("entity_type"), F.lit("name"), F.col("name"), F.lit("parent"), F.col("parent_class")), lambda k, v: v.isNotNull())
    nodes = g.select(compared_path("unique_id").alias("node"), attributes.alias("attributes"), "ordinal")
    entities = cut(current_records(table(spark, sf_dir, "repo_graph"), ["ordinal", "entity_type", "name", "calls", "bases"]))
    edges = dependency_edges(entities).select("source", "target", "type", F.lit(None).cast("double").alias("weight"), F.create_map(F.lit("kind"), F.col("type")).alias("attributes"), "ordinal")
    empty = S.GraphStore(spark.createDataFrame([], S.NODE), spark.createDataFrame([], S.EDGE))
    return empty.add_nodes(nodes).add_edges(edges)


def store_nodes(spark, sf_dir):
    a = F.col("attributes")
    return _store(spark, sf_dir).nodes.select("node", *[F.try_element_at(a, F.lit(k)).alias(k) for k in ("type", "name", "parent")])


def store_edges(spark, sf_dir):
    return _store(spark, sf_dir).edges.select("source", "target", "type", "weight")


def store_node_data(spark, sf_dir):
    """What is known of the ends of edges: some were never added."""
    s = _store(spark, sf_dir)
    return s.node_data(s.edges.select(F.col("target").alias("node"))).select("node", "known", F.size("attributes").alias("attributes"))


def store_edges_round_trip(spark, sf_dir):
    """Edges written as JSON lines and read again, by type."""
    return S.edges_from_json(S.edges_to_json(_store(spark, sf_dir).edges)).groupBy("type").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def common_folders(spark, sf_dir):
    """The folder that all files lie in, and the one of the files of the largest repository."""
    files = table(spark, sf_dir, "repo_graph").where(F.col("file").isNotNull()).select(compared_path("file").alias("path")).distinct()
    repo = F.split_part("path", F.lit("/"), F.lit(1))
    most = files.groupBy(repo.alias("_r")).agg(F.count("*").alias("_n")).orderBy(F.col("_n").desc(), "_r").limit(1)
    one = files.withColumn("_r", repo).join(F.broadcast(most), "_r", "left_semi")
    return X.common_folder(files).withColumn("of", F.lit("all")).unionByName(X.common_folder(one).withColumn("of", F.lit("largest")))


def text_formats(spark, sf_dir):
    """Names, ids and times as the interfaces show them."""
    g = table(spark, sf_dir, "repo_graph")
    return g.select("ordinal", X.iso(F.col("scanned_at")).alias("scanned"), X.shorten_middle(F.col("unique_id"), 24).alias("id"), X.shorten_end(F.col("name"), 10).alias("name"), X.pad(F.col("name"), 12).alias("padded"))


def names_in_questions(spark, sf_dir):
    return table(spark, sf_dir, "questions").select("id", F.array_join(X.names_in(F.col("query")), " ").alias("names"))


QUERIES = {f.__name__: f for f in (store_nodes, store_edges, store_node_data, store_edges_round_trip, common_folders, text_formats, names_in_questions)}

_P = r"regexp_replace(replace({0}, '\', '/'), '^(\./)+', '')"
_MID = "CASE WHEN length({0}) <= {1} THEN {0} ELSE left({0}, {2}) || '…' || right({0}, {3}) END"
SQL = {
    "store_nodes": f"""SELECT {_P.format("unique_id")} AS node, arg_max(entity_type, ordinal) AS type, arg_max(name, ordinal) AS name, arg_max(parent_class, ordinal) AS parent FROM repo_graph WHERE unique_id IS NOT NULL GROUP BY 1""",
    "store_edges": f"WITH {_EDGES} SELECT source, target, type, 1.0::DOUBLE AS weight FROM se",
    "store_node_data": f"""WITH {_EDGES}, n AS (SELECT {_P.format("unique_id")} AS node, (arg_max(entity_type, ordinal) IS NOT NULL)::INT + (arg_max(name, ordinal) IS NOT NULL)::INT + (arg_max(parent_class, ordinal) IS NOT NULL)::INT AS k FROM repo_graph WHERE unique_id IS NOT NULL GROUP BY 1)
SELECT t.node, true AS known, coalesce(n.k, 0) AS attributes FROM (SELECT DISTINCT target AS node FROM se) t LEFT JOIN n USING (node)""",
    "store_edges_round_trip": f"WITH {_EDGES} SELECT type, count(*) AS n, count(*)::DOUBLE AS weight FROM se GROUP BY type",
    "common_folders": f"""WITH f AS (SELECT DISTINCT {_P.format("file")} AS path FROM repo_graph WHERE file IS NOT NULL), r AS (SELECT split_part(path, '/', 1) AS r FROM f GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
s AS (SELECT 'all' AS of, string_split(path, '/') AS p FROM f UNION ALL SELECT 'largest', string_split(path, '/') FROM f WHERE split_part(path, '/', 1) = (SELECT r FROM r)), d AS (SELECT of, p[1:len(p) - 1] AS p FROM s), n AS (SELECT of, min(len(p)) AS m FROM d GROUP BY of),
i AS (SELECT of, unnest(range(1, m + 1)) AS i FROM n), c AS (SELECT i.of, i.i, count(DISTINCT d.p[i.i]) AS k, min(d.p[i.i]) AS seg FROM i JOIN d ON d.of = i.of GROUP BY ALL)
SELECT n.of, coalesce(string_agg(c.seg, '/' ORDER BY c.i) FILTER (c.i < coalesce((SELECT min(i) FROM c x WHERE x.of = n.of AND x.k > 1), 100000)), '') AS folder FROM n LEFT JOIN c ON c.of = n.of GROUP BY n.of""",
    "text_formats": f"""SELECT ordinal, strftime(scanned_at, '%Y-%m-%dT%H:%M:%S.%f') AS scanned, {_MID.format("unique_id", 24, 12, 11)} AS id, CASE WHEN length(name) <= 10 THEN name ELSE left(name, 9) || '…' END AS name,
  rpad(CASE WHEN length(coalesce(name, '')) <= 12 THEN coalesce(name, '') ELSE left(name, 11) || '…' END, 12, ' ') AS padded FROM repo_graph""",
    "names_in_questions": r"""WITH m AS (SELECT id, list_concat(regexp_extract_all(query, '`([^`\s]+)`', 1), regexp_extract_all(query, '\b([A-Za-z]+(?:[a-z0-9][A-Z]|_|\.[A-Za-z])[A-Za-z0-9_.]*[A-Za-z0-9_])', 1)) AS f FROM questions)
SELECT id, coalesce(array_to_string(list_filter(f, lambda x, i: list_position(f, x) = i), ' '), '') AS names FROM m""",
}
