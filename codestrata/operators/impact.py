"""Blast radius with its six risks, and the views of an impact: subgraphs, trees, node lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions import risk
from codestrata.operators.graph import degrees, reach, simple_edges
from codestrata.session import cut

RISKS = ("complexity_risk", "centrality_risk", "test_risk", "dependency_risk", "change_risk", "bus_risk")


def centrality_risk(centrality: DataFrame) -> DataFrame:
    """(node, centrality_risk): betweenness as a share of the highest; 0 in graphs of fewer than three nodes or without any."""
    top = centrality.agg(F.max("betweenness").alias("_top"), F.count("*").alias("_n"))  # one row
    share = F.when((F.col("_n") >= 3) & (F.col("_top") > 0), F.col("betweenness") / F.col("_top")).otherwise(F.lit(0.0))
    return centrality.join(F.broadcast(top)).select("node", share.alias("centrality_risk"))


def impact(edges: DataFrame, entities: DataFrame, seeds: DataFrame, centrality: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """Blast radius of every seed with its six risk factors, their weighted total, level, top risks and advice.

    Affected are all upstream nodes; direct ones call the seed; tests are affected ids
    that contain 'test'. `centrality` (node, betweenness) gives the centrality risk, else the degree does; `files` of
    history.file_risk gives change and bus risk by the entity's file: 0.3 and 0.5 for a file without history; without
    `files` the degree stands for changes and bus risk is 0.5. Seeds without any edge have zeros.
    """
    up = cut(reach(edges, seeds))
    callers = simple_edges(edges.join(seeds.select(F.col("node").alias("target")).distinct(), "target", "left_semi")).where((F.col("type") == "CALLS") & (F.col("source") != F.col("target")))
    affected = up.groupBy("seed").agg(F.count("*").alias("blast_radius"), F.sum(F.lower("node").contains("test").cast("int")).alias("tests"), F.max("hops").alias("depth"))
    direct = callers.groupBy(F.col("target").alias("seed")).agg(F.count("*").alias("direct"))
    degree = degrees(seeds.select("node").distinct(), simple_edges(edges)).select(F.col("node").alias("seed"), (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    own = entities.select(F.col("uid").alias("seed"), F.col("file_path").alias("file"), F.col("complexity.cyclomatic").alias("cyclomatic"), F.col("complexity.cognitive").alias("cognitive"))
    rows = seeds.select(F.col("node").alias("seed")).distinct().join(affected, "seed", "left").join(direct, "seed", "left").join(degree, "seed", "left").join(own, "seed", "left").na.fill(0, ["blast_radius", "tests", "depth", "direct", "degree"])
    if centrality is not None:
        rows = rows.join(centrality_risk(centrality).withColumnRenamed("node", "seed"), "seed", "left").withColumn("centrality_risk", F.coalesce("centrality_risk", F.lit(0.0)))
    else:
        rows = rows.withColumn("centrality_risk", risk.degree_change_risk(F.col("degree")))
    if files is not None:
        rows = rows.join(files.select("file", F.col("change_risk").alias("_change"), F.col("bus_risk").alias("_bus")), "file", "left")
        placed = F.col("file").isNotNull() & (F.col("file") != "")
        change = F.when(placed, F.coalesce("_change", F.lit(risk.UNKNOWN_CHANGE))).otherwise(risk.degree_change_risk(F.col("degree")))
        bus = F.when(placed, F.coalesce("_bus", F.lit(risk.UNKNOWN_BUS))).otherwise(F.lit(0.5))
    else:
        change, bus = risk.degree_change_risk(F.col("degree")), F.lit(0.5)
    parts = [risk.complexity_risk(F.col("cyclomatic"), F.col("cognitive")), F.col("centrality_risk"), risk.test_risk(F.col("tests")), risk.dependency_risk(F.col("blast_radius")), change, bus]
    r = rows.select("seed", "blast_radius", "direct", "tests", "depth", *[F.round(x, 6).alias(name) for name, x in zip(RISKS, parts)], risk.total_risk(parts).alias("_total"))
    named = dict(zip(RISKS, map(F.col, RISKS)))
    return r.select(
        F.col("seed").alias("node"), "blast_radius", "direct", (F.col("blast_radius") - F.col("direct")).alias("indirect"), F.col("tests").cast("bigint").alias("tests"), "depth", *RISKS,
        F.round("_total", 6).alias("risk"), risk.risk_level(F.round("_total", 9)).alias("level"), risk.closure_band(F.col("blast_radius")).alias("band"), (F.round("_total", 9) < 0.3).alias("safe_to_change"),
        F.array_join(risk.top_risks(named), "; ").alias("top_risks"),
        F.array_join(risk.recommendations(named["complexity_risk"], named["test_risk"], F.col("tests"), named["centrality_risk"], named["dependency_risk"], named["bus_risk"]), "; ").alias("advice"),
    )


def induced_subgraph(edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of what a change of each seed reaches: nodes(seed, node, hops, refs, level), edges(seed, source, target, n).

    `refs` counts the edges into a node from within, parallel ones each; levels by that count.
    """
    inside = cut(reach(edges, seeds).select("seed", "node", "hops").unionByName(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hops")).distinct()))
    within = edges.join(inside.select("seed", F.col("node").alias("target")), "target").join(inside.select("seed", F.col("node").alias("source")), ["seed", "source"], "left_semi")
    pairs = cut(within.groupBy("seed", "source", "target").agg(F.count("*").alias("n")))
    refs = pairs.groupBy("seed", F.col("target").alias("node")).agg(F.sum("n").alias("refs"))
    nodes = inside.join(refs, ["seed", "node"], "left").select("seed", "node", "hops", F.coalesce("refs", F.lit(0)).alias("refs"))
    return nodes.withColumn("level", risk.reference_level(F.col("refs"))), pairs


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node, way, n): what a seed is linked with directly, 'in' and 'out', with the number of edges."""
    s = seeds.select(F.col("node").alias("seed")).distinct()
    into = edges.join(s, F.col("target") == F.col("seed")).select("seed", F.col("source").alias("node"), F.lit("in").alias("way"))
    out = edges.join(s, F.col("source") == F.col("seed")).select("seed", F.col("target").alias("node"), F.lit("out").alias("way"))
    return into.unionByName(out).groupBy("seed", "node", "way").agg(F.count("*").alias("n"))


def impact_tree(edges: DataFrame, entities: DataFrame, seeds: DataFrame, depth: int = 3, files: int = 20, per_file: int = 8, most_edges: int = 30) -> dict[str, DataFrame]:
    """The tree view of an impact: `paths`(seed, path, depth, node, more) without cycles, `shown`(seed, file, node, place), `edges`.

    Paths grow upstream from the seed over `depth` levels; at the last one `more` counts what is left out. Shown are the
    first `files` files by their highest number of hits, and in each the first `per_file` nodes by hops and id; of their
    edges the first `most_edges` by id.
    """
    step = cut(edges.select(F.col("target").alias("node"), F.col("source").alias("_child")).where(F.col("source") != F.col("target")).distinct())
    front = seeds.select(F.col("node").alias("seed"), "node").distinct().withColumn("path", F.array("node")).withColumn("depth", F.lit(0))
    levels = [front]
    for k in range(1, depth + 1):
        front = cut(front.join(step, "node").where(~F.array_contains("path", F.col("_child"))).select("seed", F.col("_child").alias("node"), F.concat("path", F.array("_child")).alias("path"), F.lit(k).alias("depth")))
        levels.append(front)
    left = step.groupBy("node").agg(F.count("*").alias("_more"))
    paths = levels[0]
    for x in levels[1:]:
        paths = paths.unionByName(x)
    paths = paths.join(left, "node", "left").select("seed", F.array_join("path", " < ").alias("path"), "depth", "node", F.when(F.col("depth") == depth, F.coalesce("_more", F.lit(0))).otherwise(F.lit(0)).alias("more"))
    hit = reach(edges, seeds, max_hops=depth).join(entities.select(F.col("uid").alias("node"), F.col("file_path").alias("file")), "node").where(F.col("file").isNotNull())
    ranked_files = hit.groupBy("seed", "file").agg(F.count("*").alias("_n")).withColumn("_f", F.row_number().over(Window.partitionBy("seed").orderBy(F.col("_n").desc(), "file"))).where(F.col("_f") <= files)
    place = F.row_number().over(Window.partitionBy("seed", "file").orderBy("hops", "node"))
    shown = cut(hit.join(ranked_files.select("seed", "file"), ["seed", "file"]).withColumn("place", place).where(F.col("place") <= per_file).select("seed", "file", "node", "hops", "place"))
    some = shown.select("seed", "node").unionByName(seeds.select(F.col("node").alias("seed"), "node").distinct())
    links = simple_edges(edges).select("source", "target").join(some.select("seed", F.col("node").alias("target")), "target").join(some.select("seed", F.col("node").alias("source")), ["seed", "source"], "left_semi")
    links = links.withColumn("_k", F.row_number().over(Window.partitionBy("seed").orderBy("source", "target"))).where(F.col("_k") <= most_edges).select("seed", "source", "target")
    return {"paths": paths, "shown": shown, "edges": links}


def blast_share(rows: DataFrame, functions: Column) -> DataFrame:
    """`impact` rows with the share of all functions that is affected, in percent, and what it calls for (over 30, over 10)."""
    share = F.round(F.col("blast_radius") / F.greatest(functions, F.lit(1)) * 100, 4)
    return rows.withColumn("share", share).withColumn("share_flag", F.when(share > 30, "very wide").when(share > 10, "wide").otherwise("contained"))


def node_view(nodes: DataFrame, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(node, type, in_degree, out_degree, level, connectivity, complexity, weight): every node as the graph view draws it.

    The declared type, else class for ids with a dot after the file or an upper-case first letter, else function; the
    out-degree stands for complexity.
    """
    d = degrees(nodes, simple_edges(edges))
    last = F.element_at(F.split("node", ":"), -1)
    kind = F.coalesce("entity_type", F.when(F.contains(last, F.lit(".")) | last.rlike("^[A-Z]"), "class").otherwise("function"))
    degree = F.col("in_degree") + F.col("out_degree")
    level = risk.degree_level(degree)
    return d.join(entities.select(F.col("uid").alias("node"), "entity_type"), "node", "left").select("node", kind.alias("type"), "in_degree", "out_degree", level.alias("level"), F.least(degree / 10, F.lit(1.0)).alias("connectivity"), F.least(F.col("out_degree") / 15, F.lit(1.0)).alias("complexity"), risk.level_weight(level).alias("weight"))


def edge_view(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target, type, level): distinct edges in the colour of their target's level."""
    return simple_edges(edges).join(nodes.select(F.col("node").alias("target"), "level"), "target").select("source", "target", "type", "level")


def visible_edges(edges: DataFrame, rolled: DataFrame, open_directories: DataFrame, open_files: DataFrame) -> DataFrame:
    """(from_node, to_node) between what is visible: an entity in an open file of an open directory, else the file, else the directory.

    rolled(id, file, directory) as of rollup; edges inside one visible node and of nodes without a file are dropped.
    """
    r = rolled.select("id", "file", "directory").join(open_directories.select("directory", F.lit(True).alias("_d")), "directory", "left").join(open_files.select("file", F.lit(True).alias("_f")), "file", "left")
    seen = r.select("id", F.when(F.col("_d").isNull(), F.col("directory")).when(F.col("_f").isNull(), F.col("file")).otherwise(F.col("id")).alias("_at"))
    ends = edges.join(seen.select(F.col("id").alias("source"), F.col("_at").alias("from_node")), "source").join(seen.select(F.col("id").alias("target"), F.col("_at").alias("to_node")), "target")
    return ends.where(F.col("from_node") != F.col("to_node")).select("from_node", "to_node").distinct()
