"""Shares of shortest paths in a graph that a task can hold: many starts at a time, breadth-first, in arrays."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Nodes and links, once a start, that a task works on at a time.
CELLS = 4_000_000


class Held(NamedTuple):
    """Nodes by number in ascending order; node i has links to ends[starts[i]:starts[i + 1]]."""

    nodes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def hold(source: np.ndarray, target: np.ndarray) -> Held:
    nodes = np.unique(np.concatenate([source, target]))
    s, t = np.searchsorted(nodes, source), np.searchsorted(nodes, target)
    order = np.lexsort((t, s))
    return Held(nodes, np.searchsorted(s[order], np.arange(len(nodes) + 1)), t[order])


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from starts[i] on, sizes[i] of them, for one i after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def shares(batches: Iterator[pa.RecordBatch], held: Held) -> Iterator[pa.RecordBatch]:
    """(own, first, times) -> (node, b): what lies on shortest paths, summed over the starts of a task.

    A start is a node `own` of the held graph, or one outside (null) that has links to the nodes `first` and none into it;
    it counts `times` times. Paths are counted outwards, then shares are handed back hop by hop (Brandes).
    """
    n = len(held.nodes)
    step = max(1, CELLS // max(1, n + len(held.ends)))
    depth, place = np.full(step * n, -1, np.int32), np.zeros(step * n, np.int64)
    paths, share, total = np.zeros(step * n), np.zeros(step * n), np.zeros(n)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            own, first, times = batch.slice(at, step).columns
            inside = own.is_valid().to_numpy(zero_copy_only=False)
            sizes, flat, times = first.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), first.flatten().to_numpy(), times.to_numpy().astype(float)
            row = np.arange(len(own)) * n
            own = np.searchsorted(held.nodes, own.drop_null().to_numpy())
            roots = row[inside] + own
            depth[roots] = 0
            degree = held.starts[own + 1] - held.starts[own]
            keys = np.concatenate([np.repeat(row, sizes) + np.searchsorted(held.nodes, flat), np.repeat(row[inside], degree) + held.ends[ranges(held.starts[own], degree)]])
            depth[keys], paths[keys] = 1, 1
            met, links, hops = [keys], [], 1
            while len(keys):
                node = keys % n
                degree = held.starts[node + 1] - held.starts[node]
                child = np.repeat(keys - node, degree) + held.ends[ranges(held.starts[node], degree)]
                new = depth[child] == -1
                parent, child = np.repeat(keys, degree)[new], child[new]
                hops += 1
                depth[child] = hops
                np.add.at(paths, child, paths[parent])
                place[child] = np.arange(len(child))
                keys = child[place[child] == np.arange(len(child))]  # each once
                met.append(keys)
                links.append((parent, child))
            for parent, child in reversed(links):
                np.add.at(share, parent, paths[parent] / paths[child] * (1 + share[child]))
            keys = np.concatenate(met)
            total += np.bincount(keys % n, share[keys] * times[keys // n], n)
            depth[keys], depth[roots], paths[keys], share[keys] = -1, -1, 0, 0
    some = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(held.nodes[some]), pa.array(total[some])], ["node", "b"])
