"""A graph kept as two tables: nodes by id and edges by their ends, with the primitives of a graph store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = "node string, attributes map<string,string>, ordinal bigint"
EDGE = "source string, target string, type string, weight double, attributes map<string,string>, ordinal bigint"


def merged(old: Column, new: Column) -> Column:
    """Attributes of both maps, those of `new` where both have a key; null maps are empty."""
    none = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(old, none), F.coalesce(new, none)
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def _last_wins(rows: DataFrame, keys: list[str], plain: list[str]) -> DataFrame:
    """One row a key: attributes are merged in the order of `ordinal`, other columns are the last row's."""
    packed = F.array_sort(F.collect_list(F.struct("ordinal", *plain, F.map_entries(F.coalesce("attributes", F.create_map().cast("map<string,string>"))).alias("_a"))))
    g = rows.groupBy(*keys).agg(packed.alias("_r"))
    pairs = F.aggregate("_r", F.create_map().cast("map<string,string>"), lambda acc, r: merged(acc, F.map_from_entries(r["_a"])))
    last = F.element_at("_r", -1)
    return g.select(*keys, *[last[c].alias(c) for c in plain], pairs.alias("attributes"), last["ordinal"].alias("ordinal"))


@dataclass(frozen=True)
class GraphStore:
    """nodes(NODE) and edges(EDGE). Every change gives a new store; nothing is written until `nodes` or `edges` are."""

    nodes: DataFrame
    edges: DataFrame

    def add_nodes(self, more: DataFrame) -> GraphStore:
        """Upsert: a node's attributes are updated by those of the rows with higher ordinals. The rows of one node are few."""
        return GraphStore(_last_wins(self.nodes.unionByName(more).where(F.col("node").isNotNull()), ["node"], []), self.edges)

    def add_edges(self, more: DataFrame) -> GraphStore:
        """One edge between two nodes: later rows overwrite type and weight (null weights are 1) and update attributes."""
        given = self.edges.unionByName(more.withColumn("weight", F.coalesce("weight", F.lit(1.0)))).where(F.col("source").isNotNull() & F.col("target").isNotNull())
        return GraphStore(self.nodes, _last_wins(given, ["source", "target"], ["type", "weight"]))

    def all_nodes(self) -> DataFrame:
        """Nodes that were added and ends of edges that weren't."""
        return self.nodes.select("node").union(self.edges.select("source")).union(self.edges.select("target")).distinct()

    def node_data(self, wanted: DataFrame) -> DataFrame:
        """wanted(node) -> (node, known, attributes): no attributes where the node was never added."""
        have = self.nodes.select("node", "attributes", F.lit(True).alias("_own"))
        ends = self.all_nodes().withColumn("_any", F.lit(True))
        none = F.create_map().cast("map<string,string>")
        return wanted.select("node").distinct().join(ends, "node", "left").join(have, "node", "left").select("node", F.col("_any").isNotNull().alias("known"), F.coalesce("attributes", none).alias("attributes"))

    def edge_data(self, wanted: DataFrame) -> DataFrame:
        """wanted(source, target) -> (source, target, known, type, weight): nulls for edges that there aren't."""
        have = self.edges.select("source", "target", "type", "weight", F.lit(True).alias("_k"))
        return wanted.select("source", "target").distinct().join(have, ["source", "target"], "left").select("source", "target", F.col("_k").isNotNull().alias("known"), "type", "weight")

    def between(self, source: str | None = None, target: str | None = None, type: str | None = None) -> DataFrame:
        """Edges by source, target and type, as far as given."""
        out = self.edges
        for c, v in (("source", source), ("target", target), ("type", type)):
            out = out if v is None else out.where(F.col(c) == v)
        return out

    def around(self, node: str) -> DataFrame:
        """(node, way) of predecessors ('in') and successors ('out')."""
        into = self.between(target=node).select(F.col("source").alias("node"), F.lit("in").alias("way"))
        return into.unionByName(self.between(source=node).select(F.col("target").alias("node"), F.lit("out").alias("way"))).distinct()

    def cleared(self) -> GraphStore:
        return GraphStore(self.nodes.limit(0), self.edges.limit(0))


def edges_to_json(edges: DataFrame) -> DataFrame:
    """(value): an edge a line, without null fields."""
    return edges.select(F.to_json(F.struct("source", "target", "type", "weight", "attributes", "ordinal")).alias("value"))


def edges_from_json(lines: DataFrame) -> DataFrame:
    """Edges of JSON lines; a missing weight is 1, lines without both ends are left out."""
    e = lines.select(F.from_json("value", EDGE).alias("e")).select("e.*").where(F.col("source").isNotNull() & F.col("target").isNotNull())
    return e.withColumn("weight", F.coalesce("weight", F.lit(1.0)))
