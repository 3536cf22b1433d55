"""Searches from every vertex of a graph, the sources dealt over tasks.

A task is given the graph's edges by a shuffle, searches from its share of the sources, a batch at a time, and returns one row for each
vertex: what its searches add up to there. Nothing is kept for a pair of vertices beyond a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges (both directions counted) that every task may hold.
EDGES = 4_000_000

#: Numbers of a batch: vertices times sources, or times words of 64 sources.
CELLS = 2_000_000

#: Vertices of more neighbours are taken one by one, the others together, a neighbour at a time.
HUB = 256


class Graph:
    """Neighbours of vertices, which are numbered by falling degree; both directions of every edge are given."""

    def __init__(self, src: np.ndarray, dst: np.ndarray) -> None:
        ids, n = np.unique(src, return_counts=True)
        by = np.argsort(-n, kind="stable")
        self.ids, self.degree, self.number = ids[by], n[by], np.empty(len(ids), np.int64)
        self.number[by] = np.arange(len(ids))  # of the vertices in order of their ids
        a, b = (self.number[np.searchsorted(ids, x)] for x in (src, dst))
        self.near = b[np.argsort(a, kind="stable")]
        self.first = np.cumsum(self.degree) - self.degree
        self._mark = np.zeros(len(ids), bool)

    def beside(self, rows: np.ndarray) -> np.ndarray:
        """The vertices next to any of rows, in order."""
        d = self.degree[rows]
        to = self.near[np.repeat(self.first[rows] - (np.cumsum(d) - d), d) + np.arange(d.sum())]
        self._mark[to] = True
        out = np.flatnonzero(self._mark)
        self._mark[out] = False
        return out

    def around(self, x: np.ndarray, rows: np.ndarray, join: np.ufunc) -> np.ndarray:
        """For each of rows, which rise: x of its neighbours, joined."""
        d, first = self.degree[rows], self.first[rows]
        out = np.empty((len(rows), x.shape[1]), x.dtype)
        hubs = np.searchsorted(-d, -HUB)
        for i in range(hubs):
            out[i] = join.reduce(x[self.near[first[i] : first[i] + d[i]]], axis=0)
        rest, d, first = out[hubs:], -d[hubs:], first[hubs:]
        if len(rest):
            np.take(x, self.near[first], axis=0, out=rest)
            for j in range(1, -d[0]):
                k = np.searchsorted(d, -j)
                join(rest[:k], x[self.near[first[:k] + j]], out=rest[:k])
        return out


def _passing(g: Graph, weight: np.ndarray, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What lies on shortest paths from the sources, summed over them by weight of both ends, and the weight that each source reaches."""
    shape = (len(g.ids), len(sources))
    paths, hop, front, owed = np.zeros(shape), np.full(shape, -1, np.int32), np.zeros(shape), np.zeros(shape)
    at = np.arange(len(sources))
    paths[sources, at], hop[sources, at], front[sources, at] = 1, 0, 1
    levels = [np.unique(sources)]
    while True:
        rows = g.beside(levels[-1])
        new = g.around(front, rows, np.add)
        new[hop[rows] >= 0] = 0
        front[levels[-1]] = 0
        some = new.any(axis=1)
        rows, new = rows[some], new[some]
        if not len(rows):
            break
        hop[rows] = np.where(new > 0, len(levels), hop[rows])
        paths[rows] += new
        front[rows] = new
        levels.append(rows)
    for h in range(len(levels) - 1, 1, -1):
        low, high = levels[h], levels[h - 1]
        front[low] = np.divide(owed[low] + weight[low, None], paths[low], out=np.zeros((len(low), len(sources))), where=hop[low] == h)
        owed[high] += np.where(hop[high] == h - 1, paths[high] * g.around(front, high, np.add), 0)
        front[low] = 0
    return owed @ weight[sources], weight @ (hop >= 0)


def _distances(g: Graph, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each vertex, how many of the sources reach it, and the sum of their distances; a bit for each source."""
    words = -(-len(sources) // 64)
    seen = np.zeros((len(g.ids), words), np.uint64)
    at = np.arange(len(sources))
    np.bitwise_or.at(seen, (sources, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    front, rows, hop = seen.copy(), np.unique(sources), 0
    n, far = np.zeros(len(g.ids), np.int64), np.zeros(len(g.ids), np.int64)
    n[sources] = 1
    while True:
        to = g.beside(rows)
        new = g.around(front, to, np.bitwise_or) & ~seen[to]
        front[rows] = 0
        some = new.any(axis=1)
        rows, new = to[some], new[some]
        if not len(rows):
            return n, far
        hop += 1
        seen[rows] |= new
        front[rows] = new
        own = np.bitwise_count(new).sum(axis=1, dtype=np.int64)
        n[rows] += own
        far[rows] += own * hop


def _shares(g: Graph, block: int, blocks: int, most: int) -> Iterator[np.ndarray]:
    """Batches of at most so many sources, neighbours by id together; every so many-th batch is the block's."""
    size = max(1, min(most, -(-len(g.ids) // blocks)))
    for low in range(block * size, len(g.ids), blocks * size):
        yield g.number[low : low + size]


def _each(edges: DataFrame, n: int, schema: str, search: Callable[[pa.Table, int, int], pa.RecordBatch]) -> DataFrame:
    """What search returns for each block of sources; edges meet every block."""
    blocks = max(1, min(2 * edges.sparkSession.sparkContext.defaultParallelism, -(-n // 64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            table = pa.Table.from_batches(held)
            for block in pa.compute.unique(table["block"]).to_pylist():
                yield search(table.filter(pa.compute.equal(table["block"], block)), block, blocks)

    import pyarrow.compute  # noqa: F401

    every = edges.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return every.repartitionById(blocks, F.col("block")).mapInArrow(run, schema)


def passing(edges: DataFrame, n: int) -> DataFrame:
    """id, passed, size: the pairs of other vertices (by weight of both, either way round) that have the vertex on a shortest path, each
    counted by the share of its paths that do; and the weight of the vertex's component. edges: src, dst, w (the weight of src), each in
    both directions; n is the number of vertices."""

    def search(edges: pa.Table, block: int, blocks: int) -> pa.RecordBatch:
        src = edges["src"].to_numpy()
        g = Graph(src, edges["dst"].to_numpy())
        weight = np.empty(len(g.ids))
        weight[g.number[np.searchsorted(np.sort(g.ids), src)]] = edges["w"].to_numpy()
        total, size = np.zeros(len(g.ids)), np.zeros(len(g.ids))
        for sources in _shares(g, block, blocks, min(64, CELLS // len(g.ids))):
            part, size[sources] = _passing(g, weight, sources)
            total += part
        return pa.RecordBatch.from_arrays([pa.array(g.ids), pa.array(total), pa.array(size)], ["id", "passed", "size"])

    found = _each(edges, n, f"id {edges.schema['src'].dataType.simpleString()}, passed double, size double", search)
    return found.groupBy("id").agg(F.sum("passed").alias("passed"), F.max("size").alias("size"))


def distances(edges: DataFrame, n: int) -> DataFrame:
    """id, reached (itself included), far: how many vertices each reaches and the sum of their distances; edges in both directions."""

    def search(edges: pa.Table, block: int, blocks: int) -> pa.RecordBatch:
        g = Graph(edges["src"].to_numpy(), edges["dst"].to_numpy())
        reached, far = np.zeros(len(g.ids), np.int64), np.zeros(len(g.ids), np.int64)
        for sources in _shares(g, block, blocks, 64 * max(1, min(64, CELLS // len(g.ids)))):
            own, dist = _distances(g, sources)
            reached += own
            far += dist
        return pa.RecordBatch.from_arrays([pa.array(g.ids), pa.array(reached), pa.array(far)], ["id", "reached", "far"])

    found = _each(edges, n, f"id {edges.schema['src'].dataType.simpleString()}, reached long, far long", search)
    return found.groupBy("id").agg(F.sum("reached").alias("reached"), F.sum("far").alias("far"))
