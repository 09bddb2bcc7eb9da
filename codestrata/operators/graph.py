"""Code graph: name resolution, edges, degrees, closures, centrality, cycles, impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.operators import between
from codestrata.session import cut, parallelism, share_package

DEPENDENCY_TYPES = ("CALLS", "INHERITS", "IMPORTS", "USES_TYPE")


def call_name(c: Column) -> Column:
    """The last dotted segment of a call, before any '('."""
    return F.element_at(F.split(F.substring_index(c, "(", 1), r"\."), -1)


def first_by_name(entities: DataFrame) -> DataFrame:
    """(name, target, ordinal): the first entity of every name."""
    named = entities.where(F.col("name").isNotNull() & (F.col("name") != ""))
    return named.groupBy("name").agg(F.min(F.struct("ordinal", "uid")).alias("r")).select("name", F.col("r.uid").alias("target"), F.col("r.ordinal").alias("at"))


def resolve_names(calls: DataFrame, entities: DataFrame) -> DataFrame:
    """calls(call) -> (call, target): the first entity named as its last segment; else the first name that the call ends with.

    The second tier looks the suffixes of the calls left over up by equality: no pair of call and name is ever formed
    that doesn't match.
    """
    first = cut(first_by_name(entities))
    names = calls.select("call", call_name(F.col("call")).alias("name")).where(F.col("call").isNotNull()).distinct()
    exact = cut(names.join(first, "name", "left").select("call", "target"))
    left = exact.where(F.col("target").isNull()).select("call", F.substring_index("call", "(", 1).alias("text")).where(F.length("text") > 0)
    suffixes = left.select("call", F.explode(F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: F.substr("text", i))).alias("name"))
    by_suffix = suffixes.join(first, "name").groupBy("call").agg(F.min(F.struct("at", "target")).alias("r")).select("call", F.col("r.target").alias("target"))
    return exact.where(F.col("target").isNotNull()).unionByName(by_suffix)


def dependency_edges(entities: DataFrame) -> DataFrame:
    """(source, target, type, ordinal), one row per call or base: CALLS to resolved entities, INHERITS to the named class or the base as written."""
    calls = entities.where(F.col("entity_type") == "function").select("uid", "ordinal", F.explode("calls").alias("call")).where(F.col("call").isNotNull() & (F.col("call") != ""))
    resolved = calls.join(resolve_names(calls.select("call").distinct(), entities), "call").select(F.col("uid").alias("source"), "target", F.lit("CALLS").alias("type"), "ordinal")
    bases = entities.where(F.col("entity_type") == "class").select("uid", "ordinal", F.explode("bases").alias("base")).where(F.col("base").isNotNull() & (F.col("base") != ""))
    first = first_by_name(entities).select(F.col("name").alias("base"), F.col("target").alias("known"))
    inherits = bases.join(first, "base", "left").select(F.col("uid").alias("source"), F.coalesce("known", "base").alias("target"), F.lit("INHERITS").alias("type"), "ordinal")
    return resolved.unionByName(inherits)


def simple_edges(edges: DataFrame) -> DataFrame:
    """One edge per (source, target): the last one's type wins."""
    return edges.groupBy("source", "target").agg(F.max(F.struct("ordinal", "type")).alias("r")).select("source", "target", F.col("r.type").alias("type"))


def graph_nodes(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities and the ends of edges that are none."""
    return entities.select(F.col("uid").alias("node")).union(edges.select("source")).union(edges.select("target")).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree) of every node, 0 where it has no edge."""
    ends = edges.select(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("target", F.lit(0), F.lit(1)))
    all_ = ends.union(nodes.select("node", F.lit(0), F.lit(0)))
    return all_.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nodes, edges, density), density e/(n(n-1)) and 0 for fewer than two nodes."""
    n = nodes.agg(F.count("*").alias("nodes"))
    e = edges.agg(F.count("*").alias("edges"))
    density = F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(F.lit(0.0))
    return n.join(e).select("nodes", "edges", F.round(density, 9).alias("density"))  # one row each


def edge_type_counts(edges: DataFrame) -> DataFrame:
    """Counts by type and their total, in one roll-up."""
    return edges.rollup("type").agg(F.count("*").alias("n")).select(F.coalesce("type", F.lit("total")).alias("type"), "n")


def dependents(edges: DataFrame, upstream: bool = True) -> DataFrame:
    """(node, other, type): what has an edge of a dependency type to a node (or, downstream, what it has one to), each once."""
    node, other = ("target", "source") if upstream else ("source", "target")
    return edges.where(F.col("type").isin(*DEPENDENCY_TYPES)).select(F.col(node).alias("node"), F.col(other).alias("other"), "type").distinct()


#: Fronts, and what was found so far, of at most so many rows are broadcast, once they have been counted.
SMALL = 50_000


def reach(edges: DataFrame, seeds: DataFrame, upstream: bool = True, max_hops: int | None = None) -> DataFrame:
    """(seed, node, hops): every node from which a seed is reached (or that it reaches), without the seed itself.

    Semi-naive: only nodes found in the last round are extended, each (seed, node) once; it goes on until a round finds
    nothing (or max_hops are made, if given). A round writes its own front only; what was found is the fronts' union. A
    front of few rows goes to the edges, which then are not shuffled for it.
    """
    here, there = ("target", "source") if upstream else ("source", "target")
    step = cut(edges.select(F.col(here).alias("node"), F.col(there).alias("_next")).where(F.col(here) != F.col(there)).distinct())
    found = front = cut(seeds.select(F.col("node").alias("seed"), "node").distinct().withColumn("hops", F.lit(0)))
    known = n = front.count()
    held = lambda df, rows: F.broadcast(df) if rows <= SMALL else df
    k = 0
    while k != max_hops:
        k += 1
        new = step.join(held(front, n), "node").select("seed", F.col("_next").alias("node")).distinct().join(held(found.select("seed", "node"), known), ["seed", "node"], "left_anti").withColumn("hops", F.lit(k))
        front = cut(new)
        n = front.count()
        if not n:
            break
        known += n
        found = found.unionByName(front)
    return found.where(F.col("node") != F.col("seed"))


def affected_by_type(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, callers, inheritors, type_users): distinct affected nodes by the type of their edges into the seed or other affected nodes."""
    up = reach(edges, seeds).select("seed", "node")
    inside = cut(up.union(seeds.select("node", "node")).distinct())
    hit = edges.join(inside.select("seed", F.col("node").alias("target")), "target").join(up.select("seed", F.col("node").alias("source")), ["seed", "source"], "left_semi")
    n = lambda t: F.count_distinct(F.when(F.col("type") == t, F.col("source")))
    return hit.groupBy("seed").agg(n("CALLS").alias("callers"), n("INHERITS").alias("inheritors"), n("USES_TYPE").alias("type_users"))


#: Hops and most nodes that an intent's expansion takes.
EXPANSION = {"governance": (2, 20), "blast_radius": (2, 20), "architecture": (2, 20), "complexity": (1, 14)}
EXPANSION_ELSE = (1, 10)


def bounded_neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 2, per_node: int = 6, cap: int = 20) -> DataFrame:
    """(seed, node, hop): breadth-first, at most `per_node` predecessors and then as many successors of a node, `cap` nodes a seed.

    Nodes are taken in the order in which they are met: those of an earlier node first, its predecessors before its
    successors, each by id.
    """
    one = edges.where(F.col("source") != F.col("target")).select(F.col("target").alias("node"), F.col("source").alias("_next"), F.lit(0).alias("_way")).union(edges.where(F.col("source") != F.col("target")).select("source", "target", F.lit(1))).distinct()
    w = Window.partitionBy("node", "_way").orderBy("_next")
    near = cut(one.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_node).select("node", "_next", (F.col("_way") * per_node + F.col("_k")).alias("_k")))
    found = front = cut(seeds.select(F.col("node").alias("seed"), "node").distinct().withColumn("hop", F.lit(0)).withColumn("met", F.lit("")))
    for k in range(1, hops + 1):
        met = F.concat("met", F.lpad(F.col("_k").cast("string"), 3, "0"))
        new = front.join(near, "node").select("seed", F.col("_next").alias("node"), met.alias("met")).groupBy("seed", "node").agg(F.min("met").alias("met")).join(found.select("seed", "node"), ["seed", "node"], "left_anti")
        front = cut(new.select("seed", "node", F.lit(k).alias("hop"), "met"))
        found = found.unionByName(front)
    order = Window.partitionBy("seed").orderBy("hop", "met", "node")
    return found.where(F.col("hop") > 0).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= cap).select("seed", "node", "hop")


def inheritance_tree(edges: DataFrame) -> DataFrame:
    """(node, way, other): the bases ('base') and subclasses ('subclass') of every class, one level, each once."""
    i = edges.where(F.col("type") == "INHERITS").select("source", "target").distinct()
    return i.select(F.col("source").alias("node"), F.lit("base").alias("way"), F.col("target").alias("other")).unionByName(i.select(F.col("target").alias("node"), F.lit("subclass").alias("way"), F.col("source").alias("other")))


def inheritance_chain(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, ancestor, step): all parents of the seed, then of its first parent, and so on until there is none or a cycle ends it."""
    parents = cut(edges.where(F.col("type") == "INHERITS").groupBy("source").agg(F.min(F.struct("ordinal", "target")).alias("f"), F.collect_set("target").alias("all")).select(F.col("source").alias("at"), F.col("f.target").alias("first"), "all"))
    front = seeds.select(F.col("node").alias("seed"), F.col("node").alias("at"), F.array("node").alias("seen"))
    out, k = None, 0
    while True:
        k += 1
        moved = cut(front.join(parents, "at"))
        rows = moved.select("seed", F.explode("all").alias("ancestor"), F.lit(k).alias("step"))
        out = rows if out is None else out.unionByName(rows)
        front = moved.where(~F.array_contains("seen", F.col("first"))).select("seed", F.col("first").alias("at"), F.concat("seen", F.array("first")).alias("seen"))
        if not moved.take(1):
            return out


def shortest_path_counts(edges: DataFrame, sources: DataFrame | None = None) -> list[DataFrame]:
    """For each number of hops the (source, node, paths) first reached in so many: breadth-first from all sources at once.

    `paths` counts the shortest paths. A round is a join of the last front with the edges; no edge is collected. Its cost
    is the number of (source, node) pairs that reach each other; `sources` restricts it to a sample.
    """
    step = cut(edges.select(F.col("source").alias("node"), F.col("target").alias("_next")).where(F.col("source") != F.col("target")).distinct())
    starts = sources.select("node") if sources is not None else step.select("node").distinct()
    fronts = [cut(starts.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("paths")).distinct())]
    seen = fronts[0]
    while True:
        new = fronts[-1].join(step, "node").groupBy("source", F.col("_next").alias("node")).agg(F.sum("paths").alias("paths")).join(seen.select("source", "node"), ["source", "node"], "left_anti")
        front = cut(new)
        if not front.take(1):
            return fronts
        fronts.append(front)
        seen = seen.unionByName(front)


#: A graph of at most so many links between nodes that are linked to is held by every task; a larger one is counted by joins.
HELD = 2_000_000


def betweenness(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(node, betweenness), unnormalised, on the directed simple graph; with `sources` (a sample) the sum over these only.

    Only nodes that are linked to and link further can lie between others. The links between nodes that are linked to are
    counted; if there are at most HELD each task holds them and takes some of the starts, of those outside that link to the
    same nodes one for all. Otherwise shortest paths are counted by joins.
    """
    # Nodes are numbered: the rows that are counted hold two numbers instead of two ids.
    ends = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    nodes = cut(ends.select(F.monotonically_increasing_id().alias("_id"), "node"))
    number = lambda d, c: d.join(nodes.select(F.col("node").alias(c), F.col("_id")), c).drop(c).withColumnRenamed("_id", c)
    links = cut(number(number(edges.select("source", "target").where(F.col("source") != F.col("target")).distinct(), "source"), "target").select("source", "target"))
    starts = None if sources is None else number(sources.select("node").distinct(), "node")
    inner = cut(links.join(links.select(F.col("target").alias("source")).distinct(), "source", "left_semi"))
    sums = _held_shares(links, inner, starts) if inner.count() <= HELD else _joined_shares(links, starts)
    found = sums.groupBy(F.col("node").alias("_id")).agg(F.sum("b").alias("b"))
    return nodes.join(found, "_id", "left").select("node", F.round(F.coalesce("b", F.lit(0.0)), 6).alias("betweenness"))


def _held_shares(links: DataFrame, inner: DataFrame, sources: DataFrame | None) -> DataFrame:
    """(node, b), the parts of tasks, by a graph in arrays. Nodes outside `inner` have nothing on paths through them and are left out of it."""
    spark = links.sparkSession
    share_package(spark)
    rows = inner.toArrow()
    held = spark.sparkContext.broadcast(between.hold(rows["source"].to_numpy(), rows["target"].to_numpy()))
    asked = links if sources is None else links.join(sources.select(F.col("node").alias("source")), "source", "left_semi")
    linked = lambda d, c, how: d.join(c.distinct(), c.columns[0], how)
    inside = linked(asked.select("source"), inner.select("source"), "left_semi").distinct().select(F.col("source").alias("own"), F.array().cast("array<bigint>").alias("first"), F.lit(1).cast("bigint").alias("times"))
    outside = linked(linked(asked, links.select(F.col("target").alias("source")), "left_anti"), inner.select(F.col("source").alias("target")).union(inner.select("target")), "left_semi")
    alike = outside.groupBy("source").agg(F.sort_array(F.collect_list("target")).alias("first")).groupBy("first").agg(F.count("*").alias("times"))
    starts = inside.unionByName(alike.select(F.lit(None).cast("bigint").alias("own"), "first", "times"))
    return starts.repartition(2 * parallelism(spark)).mapInArrow(lambda batches: between.shares(batches, held.value), "node bigint, b double")


def _joined_shares(links: DataFrame, sources: DataFrame | None) -> DataFrame:
    """(node, b), one part a hop, by joins.

    Shortest paths are counted outwards from all sources at once, then the shares are handed back hop by hop: each step is a
    join on (source, node) and a sum, so neither edges nor paths are ever held by one task.
    """
    fronts = shortest_path_counts(links, sources)
    back = links.select(F.col("source").alias("_before"), F.col("target").alias("node"))
    total, share = None, None
    for k in range(len(fronts) - 1, -1, -1):
        here = fronts[k] if share is None else fronts[k].join(share, ["source", "node"], "left")
        here = here.withColumn("share", F.coalesce("share", F.lit(0.0)) if share is not None else F.lit(0.0))
        part = here.groupBy("node").agg(F.sum("share").alias("b"))
        total = part if total is None else total.unionByName(part)
        if k < 2:
            break
        before = fronts[k - 1].select("source", F.col("node").alias("_before"), F.col("paths").alias("_paths"))
        given = here.join(back, "node").join(before, ["source", "_before"]).groupBy("source", F.col("_before").alias("node")).agg(F.sum(F.col("_paths") / F.col("paths") * (1 + F.col("share"))).alias("share"))
        share = cut(given)
    return total


def simple_cycles(edges: DataFrame, max_length: int | None = None) -> DataFrame:
    """(cycle, length): every simple cycle (of up to max_length nodes, if given), written from its least node on.

    Nodes off all cycles are trimmed first; paths only grow over nodes greater than their start, so each cycle is found once.
    They grow until none is open or max_length is reached.
    """
    rest = cut(edges.select("source", "target").distinct())
    while True:
        n = rest.count()
        kept = rest.join(rest.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(rest.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
        rest = cut(kept.select("source", "target"))
        if rest.count() == n:
            break
    paths = rest.where(F.col("target") >= F.col("source")).select(F.col("source").alias("start"), F.col("target").alias("end"), F.array("source").alias("path"))
    paths = cut(paths)
    out, length = None, 0
    while out is None or (length != max_length and paths.take(1)):
        length += 1
        closed = paths.where(F.col("start") == F.col("end")).select(F.array_join("path", " > ").alias("cycle"), F.lit(length).alias("length"))
        out = closed if out is None else out.unionByName(closed)
        grown = paths.where(F.col("start") != F.col("end")).join(rest.select(F.col("source").alias("end"), F.col("target").alias("_t")), "end")
        paths = cut(grown.where((F.col("_t") >= F.col("start")) & ~F.array_contains("path", F.col("end"))).select("start", F.col("_t").alias("end"), F.concat("path", F.array("end")).alias("path")).where((F.col("start") == F.col("end")) | ~F.array_contains("path", F.col("end"))))
    return out.distinct()
