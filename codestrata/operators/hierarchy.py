"""Parent-child rows to full hierarchies: root, depth, path, descendants, cycles.

Nodes are numbered in the order of their ids, so that what belongs together is numbered alike, and all steps work on
numbers. Leaves are peeled until only cycles are left; a core that one task can hold is peeled to the end there, a larger
one is settled by pointer doubling. With one link of each cycle's nodes cut, the rows are a forest. Its Euler tour is a
linked list of entries and exits of the inner nodes; leaf children weigh on their parent's entry. Parallel list ranking
gives every element its distance to the end of its tour: each task ranks the stretches of the list that lie in its block
of numbers, the list of stretches that is left is ranked in the same way, or by pointer jumping where blocks don't
shorten it. The entry-exit interval of a node then gives its depth, its number of descendants and, in a scan by entry,
its ancestors' names. No step holds the children of one parent or the nodes of one tree in one task: siblings are chained
in chunks of a bounded size and the scan runs over blocks of a bounded number of tour positions, to which the ancestors
that are open at the block's start are handed in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.session import cut

#: Children of one parent that are put in order within one task, and tour positions scanned as one block.
CHUNK, BLOCK = 50_000, 100_000
#: Links peeled within one task, and list elements ranked within one.
CORE, STRETCH = 500_000, 250_000


def _parts(size: int, of: int) -> int:
    """Partitions for `size` rows, `of` each."""
    return max(1, -(-size // of))


def _empty(df: DataFrame) -> bool:
    return not df.take(1)


def _frame(batches: Iterator[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    parts = list(batches)
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: [] for c in columns})


def _peel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (id, pid) -> the ids on cycles: what is left when leaves are peeled one by one."""
    rows = _frame(batches, ["id", "pid"])
    parent = dict(zip(rows["id"].tolist(), rows["pid"].tolist()))
    children: dict[int, int] = {}
    for p in parent.values():
        children[p] = children.get(p, 0) + 1
    leaves = [i for i in parent if i not in children]
    while leaves:
        i = leaves.pop()
        p = parent.pop(i)
        children[p] -= 1
        if not children[p] and p in parent:
            leaves.append(p)
    yield pd.DataFrame({"id": pd.Series(list(parent), dtype="int64")})


def cycle_nodes(links: DataFrame, peel_rounds: int = 6) -> DataFrame:
    """(id) of the nodes that are their own ancestor, of links(id, pid) with one row per node.

    A node that is left when no leaf can be peeled any more lies on a cycle, since a node has one parent.
    """
    rest, last = links, -1
    for _ in range(peel_rounds):
        # Nodes without children, and nodes whose parent is a root.
        inner = rest.select(F.col("pid").alias("id")).distinct()
        inner = rest.join(inner, "id", "left_semi")
        rest = cut(inner.join(inner.select(F.col("id").alias("pid")), "pid", "left_semi").select("id", "pid"))
        n = rest.count()
        if n == 0 or n == last:
            return rest.select("id")
        if n <= CORE:
            return cut(rest.repartition(1).mapInPandas(_peel, "id bigint"))
        last = n
    # Deep chains: pointer doubling. After as many steps as there are nodes, exactly the cycles are pointed at.
    jump, steps = rest, 1
    while steps < last:
        to = jump.select(F.col("id").alias("pid"), F.col("pid").alias("_to"))
        jump = cut(jump.join(to, "pid").select("id", F.col("_to").alias("pid")))
        steps *= 2
    return cut(jump.select(F.col("pid").alias("id")).distinct())


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Elements (id, next, w, d, last) -> each with the sums to the end of its stretch within the partition, that end's last, and what follows it."""
    rows = _frame(batches, ["id", "next", "w", "d", "last"])
    if not len(rows):
        return
    rows = rows.sort_values("id", kind="stable")
    ids, w, d, last = (rows[c].to_numpy(np.int64) for c in ("id", "w", "d", "last"))
    follows = rows["next"].fillna(-1).to_numpy(np.int64)
    at = np.minimum(np.searchsorted(ids, follows), len(ids) - 1)
    here = np.arange(len(ids))
    jump = np.where(ids[at] == follows, at, here)
    end = jump == here
    sums = np.where(end, 0, w), np.where(end, 0, d)
    while not (jump == jump[jump]).all():
        sums = tuple(x + x[jump] for x in sums)
        jump = jump[jump]
    out = pd.DataFrame({"id": ids, "next": pd.Series(follows[jump], dtype="Int64"), "w": sums[0] + w[jump], "d": sums[1] + d[jump], "last": last[jump]})
    out["next"] = out["next"].mask(out["next"] < 0)
    yield out


def _rank_list(elements: DataFrame, n: int) -> DataFrame:
    """elements(id, next, w, d, last) -> (id, last, w, d): sums of w and d from each element on to the end of its list, and the `last` found there."""
    blocks = _parts(n, STRETCH)
    placed = elements.repartition(1) if blocks == 1 else elements.repartitionByRange(blocks, "id")
    short = cut(placed.mapInPandas(_stretches, "id bigint, next bigint, w bigint, d bigint, last bigint"))
    open_ = short.where(F.col("next").isNotNull())
    if blocks == 1 or _empty(open_):
        return short.select("id", "last", "w", "d")
    heads = open_.select(F.col("next").alias("id")).distinct()
    rest = cut(short.join(heads, "id", "left_semi").select("id", "next", "w", "d", "last"))
    m = rest.count()
    # Blocks shorten a list whose elements lie near what follows them; another is halved by jumping.
    ranked = _rank_list(rest, m) if m <= STRETCH or 2 * m <= n else _jump(rest)
    after = ranked.select(F.col("id").alias("next"), F.col("last").alias("_l"), F.col("w").alias("_w"), F.col("d").alias("_d"))
    done = short.where(F.col("next").isNull()).select("id", "last", "w", "d")
    return done.unionByName(open_.join(after, "next").select("id", F.col("_l").alias("last"), (F.col("w") + F.col("_w")).alias("w"), (F.col("d") + F.col("_d")).alias("d")))


def _jump(ranked: DataFrame) -> DataFrame:
    """elements(id, next, w, d, last) -> (id, last, w, d) by pointer jumping, three jumps a round."""
    while not _empty(ranked.where(F.col("next").isNotNull())):
        open_ = ranked
        for _ in range(3):
            to = ranked.select(F.col("id").alias("next"), F.col("next").alias("_n"), F.col("w").alias("_w"), F.col("d").alias("_d"), F.col("last").alias("_l"))
            # Ended elements get keys of their own: nulls would all go to one partition.
            open_ = open_.withColumn("next", F.coalesce("next", -1 - F.col("id"))).join(to, "next", "left").select(
                "id",
                F.col("_n").alias("next"),
                (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"),
                (F.col("d") + F.coalesce("_d", F.lit(0))).alias("d"),
                F.coalesce("_l", "last").alias("last"),
            )
        ranked = cut(open_)
    return ranked.select("id", "last", "w", "d")


def spine_intervals(spine: DataFrame, leaves: DataFrame, n: int) -> DataFrame:
    """Inner nodes spine(id, pid, _leaf_children) -> (id, root, entry, exit, depth) of the tour of all nodes of a tree.

    Positions count from 0 in each tree's own tour, in which every node has an entry and an exit; a node's leaf children
    follow its entry. `n` is the number of inner nodes: the inner children of any one parent are put in order in chunks of
    about CHUNK.
    """
    chunks = _parts(n, CHUNK)
    chunk = F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int") if chunks > 1 else F.lit(0)
    kids = spine.where(F.col("pid").isNotNull()).select("pid", "id").withColumn("chunk", chunk)
    w = Window.partitionBy("pid", "chunk").orderBy("id")
    kids = kids.withColumn("_next", F.lead("id").over(w)).withColumn("_place", F.row_number().over(w))
    if chunks == 1:
        sibling = kids.select("id", F.col("_next").alias("_sibling"), F.when(F.col("_place") == 1, F.col("pid")).alias("_first_of"))
    else:
        kids = cut(kids)
        over = Window.partitionBy("pid").orderBy("chunk")
        heads = kids.where(F.col("_place") == 1).select("pid", "chunk", F.col("id").alias("_head")).withColumn("_next_head", F.lead("_head").over(over)).withColumn("_rank", F.row_number().over(over))
        sibling = kids.join(heads, ["pid", "chunk"]).select("id", F.coalesce("_next", "_next_head").alias("_sibling"), F.when((F.col("_place") == 1) & (F.col("_rank") == 1), F.col("pid")).alias("_first_of"))
    sibling = cut(sibling)
    first = sibling.where(F.col("_first_of").isNotNull()).select(F.col("_first_of").alias("id"), F.col("id").alias("_first"))
    weight = leaves.groupBy(F.col("pid").alias("id")).agg(F.count("*").alias("_leaves"))
    whole = spine.select("id", "pid").join(first, "id", "left").join(sibling.select("id", "_sibling"), "id", "left").join(weight, "id", "left")
    enter, leave = F.col("id") * 2, F.col("id") * 2 + 1
    element = lambda id_, next_, w_, d_: F.struct(id_.alias("id"), next_.alias("next"), w_.cast("bigint").alias("w"), F.lit(d_).cast("bigint").alias("d"))
    elements = whole.select(
        F.explode(
            F.array(
                element(enter, F.coalesce(F.col("_first") * 2, leave), 1 + 2 * F.coalesce("_leaves", F.lit(0)), 1),
                element(leave, F.coalesce(F.col("_sibling") * 2, F.col("pid") * 2 + 1), F.lit(1), -1),
            )
        ).alias("e")
    ).select("e.*", F.col("e.id").alias("last"))
    # Going from an element to the end, w counts positions and d sums +1 and -1: at a node's entry d is -depth.
    entry = F.col("id") % 2 == 0
    ends = cut(
        _rank_list(elements, 2 * n)
        .groupBy(F.shiftright("id", 1).alias("id"))
        .agg(F.max(F.when(entry, F.col("w"))).alias("_we"), F.max(F.when(~entry, F.col("w"))).alias("_wx"), F.max(F.when(entry, F.col("d"))).alias("_d"), F.max(F.shiftright("last", 1)).alias("root"))
    )
    length = ends.where(F.col("id") == F.col("root")).select("root", F.col("_we").alias("_all"))
    return ends.join(length, "root").select("id", "root", (F.col("_all") - F.col("_we")).alias("entry"), (F.col("_all") - F.col("_wx")).alias("exit"), (-F.col("_d")).alias("depth"))


def _scan_paths(separator: str):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, stack = None, []
        for pdf in batches:
            ids, paths = [], []
            for root, block, exit_, name, i, carried in zip(pdf["root"], pdf["block"], pdf["exit"], pdf["name"], pdf["id"], pdf["carried"]):
                if (root, block) != at:
                    at, stack = (root, block), []
                while stack and stack[-1][0] < exit_:
                    stack.pop()
                path = stack[-1][1] + separator + name if stack else name
                stack.append((exit_, path))
                if not carried:
                    ids.append(i)
                    paths.append(path)
            if ids:
                yield pd.DataFrame({"id": ids, "path": paths})

    return scan


def paths_by_interval(at: DataFrame, separator: str = "/") -> DataFrame:
    """at(id, root, entry, exit, name) -> (id, path): names from the root to the node, by one scan in order of entry."""
    own = at.withColumn("block", F.floor(F.col("entry") / BLOCK)).withColumn("carried", F.lit(False))
    spans = at.where(F.floor(F.col("entry") / BLOCK) < F.floor(F.col("exit") / BLOCK))
    carried = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("entry") / BLOCK) + 1, F.floor(F.col("exit") / BLOCK)))).withColumn("carried", F.lit(True))
    columns = ["root", "block", "entry", "exit", F.coalesce("name", F.lit("")).alias("name"), "id", "carried"]
    rows = own.select(*columns).unionByName(carried.select(*columns))
    return rows.repartition("root", "block").sortWithinPartitions("root", "block", "entry").mapInPandas(_scan_paths(separator), "id bigint, path string")


def hierarchy(nodes: DataFrame, separator: str = "/") -> DataFrame:
    """nodes(node, parent, name) -> (node, root, depth, path, n_descendants, state).

    `parent` is null for roots; a parent that is no node makes its child a root. Of repeated nodes one row counts (the
    least parent); rows without node are left out. `state` is tree, cycle or below_cycle; for the last two root and
    path are '' and depth is -1. A node of a cycle has all other nodes of its component as descendants. A null name
    is the empty string in paths. Empty in, empty out.
    """
    given = cut(nodes.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct("parent", "name")).alias("_r")).select("node", F.col("_r.parent").alias("parent"), F.col("_r.name").alias("name")))
    base = cut(given.repartitionByRange("node").withColumn("id", F.monotonically_increasing_id()))
    # Rows without parent have no link, so no key that a third of all rows might share by being null.
    links = cut(base.where(F.col("parent").isNotNull()).select("id", "parent").join(base.select(F.col("node").alias("parent"), F.col("id").alias("pid")), "parent").select("id", "pid"))
    cycles = cycle_nodes(links)
    ringed = not _empty(cycles)
    forest = links.join(cycles, "id", "left_anti") if ringed else links
    inner = forest.select(F.col("pid").alias("id")).distinct().withColumn("_inner", F.lit(True))
    marked = cut(base.select("id", "node", "name").join(forest, "id", "left").join(inner, "id", "left"))
    spine, leaves, lone = marked.where("_inner"), marked.where(F.col("_inner").isNull() & F.col("pid").isNotNull()), marked.where(F.col("_inner").isNull() & F.col("pid").isNull())
    at = cut(spine_intervals(spine, leaves, spine.count()).join(spine.select("id", "node", "name"), "id"))
    paths = paths_by_interval(at.select("id", "root", "entry", "exit", "name"), separator)
    root_names = at.where(F.col("id") == F.col("root")).select("root", F.col("node").alias("root_node"))
    below = ((F.col("exit") - F.col("entry") - 1) / 2).cast("int").alias("size")
    inside = cut(at.join(paths, "id").join(root_names, "root").select("id", "node", F.col("root").alias("root_id"), "root_node", F.col("depth").cast("int").alias("depth"), "path", below))
    parents = inside.select(F.col("id").alias("pid"), "root_id", "root_node", (F.col("depth") + 1).alias("depth"), F.col("path").alias("_above"))
    own_name = F.coalesce("name", F.lit(""))
    outside = leaves.join(parents, "pid").select("id", "node", "root_id", "root_node", "depth", F.concat("_above", F.lit(separator), own_name).alias("path"), F.lit(0).alias("size"))
    alone = lone.select("id", "node", F.col("id").alias("root_id"), F.col("node").alias("root_node"), F.lit(0).alias("depth"), own_name.alias("path"), F.lit(0).alias("size"))
    placed = inside.unionByName(outside).unionByName(alone)
    columns = lambda root, depth, path, n, state: ["node", root.alias("root"), depth.alias("depth"), path.alias("path"), n.alias("n_descendants"), state.alias("state")]
    if not ringed:
        return placed.select(*columns(F.col("root_node"), F.col("depth"), F.col("path"), F.col("size"), F.lit("tree")))
    # Sizes of the components with a cycle: the trees that hang on its nodes, summed along the ring by label doubling.
    placed = cut(placed)
    ring = links.join(cycles, "id", "left_semi").join(placed.select("id", (F.col("size") + 1).alias("size")), "id").select("id", F.col("pid").alias("next"), "size")
    totals = _ring_totals(ring).select("id", "total")
    rings = cycles.select(F.col("id").alias("root_id"), F.lit(True).alias("_ring"))
    all_ = placed.join(rings, "root_id", "left").join(totals, "id", "left")
    lost, on = F.col("_ring").isNotNull(), F.col("total").isNotNull()
    return all_.select(
        *columns(
            F.when(lost, F.lit("")).otherwise(F.col("root_node")), F.when(lost, F.lit(-1)).otherwise(F.col("depth")), F.when(lost, F.lit("")).otherwise(F.col("path")),
            F.when(on, (F.col("total") - 1).cast("int")).otherwise(F.col("size")), F.when(on, "cycle").when(lost, "below_cycle").otherwise("tree"),
        )
    )


def _ring_totals(ring: DataFrame) -> DataFrame:
    """ring(id, next, size), disjoint directed cycles -> (id, total of size along its cycle)."""
    ring = cut(ring)
    n, steps = ring.count(), 1
    label = ring.select("id", "next", F.col("id").alias("least"))
    while steps < n:
        to = label.select(F.col("id").alias("next"), F.col("next").alias("_n"), F.col("least").alias("_l"))
        # Grouped, though nodes are unique: a checkpoint keeps what the optimiser knows of its columns, which a chain of
        # projections would multiply every round.
        both = label.join(to, "next").groupBy("id")
        stepped = cut(both.agg(F.min("_n").alias("next"), F.min(F.least("least", "_l")).alias("least"), F.max(F.col("_l") < F.col("least")).alias("_moved")))
        moved = stepped.where("_moved").take(1)
        label, steps = stepped.drop("_moved"), steps * 2
        if not moved:
            break
    sized = label.select("id", "least").join(ring.select("id", "size"), "id")
    return sized.join(sized.groupBy("least").agg(F.sum("size").alias("total")), "least").select("id", "total")
