"""Exact top-k search by inner product with MaxScore.

A query's terms are the dimensions in which it is not zero; a term's posting list holds
the candidates' weights there, and its upper bound is the most it can add to any score in
the shard. Terms are sorted by bound. Those whose bounds together stay below the score to
beat are non-essential: a candidate found in none of the other, essential lists cannot
enter. Essential lists are traversed; the rest are probed, largest bound first, only for
candidates whose partial score plus what is left may still reach the score to beat. Each
shard gives every query its k best; a window merges the shards.

Candidates are dealt to shards of about ``shard_rows`` by a hash of the id, queries to
blocks of ``block_rows``; a task holds one block and one shard, whatever the table's size,
and neither side is broadcast. A common vector is only equal weights: nothing groups by it.

Components count up to the ends of 64-bit integers. Vectors with components so large that their
products could leave 64 bits are scored one by one in whole numbers of any length, and a score
beyond 64 bits counts as the nearest 64-bit integer.

Defined cases: vectors that are null or hold null or non-finite components take no part,
neither as queries nor as candidates; empty vectors score 0 with all; components beyond a
shorter vector count as 0; ties go to the smaller id; rows that repeat an id are candidates
each, but not for a query of that id; queries that repeat an id with other vectors have
rankings of their own under that id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantized(vector: str = "embedding", scale: int = 256) -> Column:
    """floor(scale * x) of every component, null for vectors that take no part."""
    v = F.col(vector)
    fit = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(fit, F.transform(v, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    """A list column as rows of equal width, short lists filled with 0."""
    lists = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    flat, n = lists.flatten().to_numpy(zero_copy_only=False), len(lists)
    size = np.diff(lists.offsets.to_numpy())
    wide = int(size.max()) if n else 0
    if n and (size == wide).all():
        return flat.reshape(n, wide).astype(np.int64)
    out = np.zeros((n, wide), np.int64)
    out[np.repeat(np.arange(n), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


class Postings:
    """One shard: for each dimension the candidates with a weight there, as rows and weights.

    Rows are in the order of ids, so that a smaller row is a smaller id. A list that holds
    every row is kept as a plain column.
    """

    def __init__(self, ids: np.ndarray, weights: np.ndarray, wide: int, dtype: type) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.dtype = ids[order], dtype
        weights = weights[order].astype(dtype)
        self.rows: list[np.ndarray | None] = []
        self.weights: list[np.ndarray] = []
        for t in range(wide):
            w = weights[:, t] if t < weights.shape[1] else np.zeros(len(ids), dtype)
            rows = np.flatnonzero(w)
            self.rows.append(None if len(rows) == len(w) else rows)
            self.weights.append(np.ascontiguousarray(w if len(rows) == len(w) else w[rows]))
        self.high = np.array([max(w.max(initial=0), 0) if r is not None else w.max(initial=0) for r, w in zip(self.rows, self.weights, strict=True)], dtype)
        self.low = np.array([min(w.min(initial=0), 0) if r is not None else w.min(initial=0) for r, w in zip(self.rows, self.weights, strict=True)], dtype)

    def add(self, score: np.ndarray, t: int, q, upto: int | None = None) -> None:
        rows, w = self.rows[t], self.weights[t]
        if rows is None:
            score += w[: len(score)] * q
        else:
            end = np.searchsorted(rows, len(score)) if upto is not None else len(rows)
            score[rows[:end]] += w[:end] * q

    def probe(self, at: np.ndarray, t: int, q) -> np.ndarray:
        rows, w = self.rows[t], self.weights[t]
        if rows is None:
            return w[at] * q
        if not len(rows):
            return np.zeros(len(at), self.dtype)
        k = np.minimum(np.searchsorted(rows, at), len(rows) - 1)
        return np.where(rows[k] == at, w[k] * q, 0)

    def best(self, query: np.ndarray, own: int, k: int, seed: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best, by score, then by id."""
        n = len(self.ids)
        terms = np.flatnonzero(query)
        bound = np.where(query[terms] > 0, query[terms] * self.high[terms], query[terms] * self.low[terms])
        terms, bound = terms[np.argsort(bound)], np.sort(bound)
        # The score to beat: the k-th best of the first rows, which are scored in full.
        head = np.zeros(min(seed, n), self.dtype)
        for t in terms:
            self.add(head, t, query[t], len(head))
        other = self.ids[: len(head)] != own
        beat = np.partition(head[other], -k)[-k] if other.sum() >= k else None
        if beat is None:
            essential = 0
        else:
            essential = int(np.searchsorted(np.maximum.accumulate(np.cumsum(bound)), beat, "left"))  # together below the score to beat
        score = np.zeros(n, self.dtype)
        seen = np.zeros(n, bool) if beat is not None and beat > 0 else np.ones(n, bool)
        for t in terms[essential:]:
            self.add(score, t, query[t])
            if self.rows[t] is None:
                seen[:] = True
            else:
                seen[self.rows[t]] = True
        at = np.flatnonzero(seen & (self.ids != own))
        partial = score[at]
        left = bound[:essential].sum()
        for t, b in zip(terms[:essential][::-1], bound[:essential][::-1], strict=True):
            if beat is not None:
                keep = partial + left >= beat
                at, partial = at[keep], partial[keep]
            partial = partial + self.probe(at, t, query[t])
            left -= b
        if beat is not None:
            keep = partial >= beat
            at, partial = at[keep], partial[keep]
        top = np.lexsort((self.ids[at], -partial))[:k]
        return at[top], partial[top]


def _exact(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers of any length, held within 64 bits."""
    q = [int(c) for c in query]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, sum(int(a) * b for a, b in zip(r, q, strict=True)))) for r in rows], np.int64)


def _search(k: int):
    def run(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "of": [], "vec_id": [], "score": []}
        if len(queries) and len(rows):
            q, x = _matrix(queries["v"]), _matrix(rows["v"])
            wide = max(q.shape[1], x.shape[1])
            q = np.pad(q, ((0, 0), (0, wide - q.shape[1])))
            x_ids, x = rows["id"].to_numpy(), np.pad(x, ((0, 0), (0, wide - x.shape[1])))
            most = 2.0**31 / max(wide, 1) ** 0.5  # products of components up to it stay within 62 bits together
            large_x, large_q = ((np.abs(m.astype(np.float64)).max(1, initial=0) > most) for m in (x, q))
            plain = float(np.abs(q[~large_q]).max(initial=0)) * float(np.abs(x[~large_x]).max(initial=0)) * max(wide, 1)
            dtype = np.float64 if plain < 2.0**53 else np.int64
            shard = Postings(x_ids[~large_x], x[~large_x], wide, dtype)
            for own, of, v, large in zip(queries["id"].to_numpy(), queries["of"].to_numpy(), q, large_q, strict=True):
                ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if not large:
                    at, score = shard.best(v.astype(dtype), own, k)
                    ids, score = shard.ids[at], score.astype(np.int64)
                if (also := (large_x | large) & (x_ids != own)).any():
                    ids, score = np.append(ids, x_ids[also]), np.append(score, _exact(x[also], v))
                    best = np.lexsort((ids, ~score))[:k]  # ~ turns the order around at either end of 64 bits
                    ids, score = ids[best], score[best]
                for c, y in zip(out.values(), (np.full(len(ids), own), np.full(len(ids), of), ids, score), strict=True):
                    c.append(y)
        return pa.table({c: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for c, x in out.items()})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256, shard_rows: int = 4096, block_rows: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best candidates other than itself."""
    one = lambda df: df.select(F.col(key).cast("long").alias("id"), quantized(vector, scale).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    x, q = one(vectors), one(queries).distinct().withColumn("of", F.xxhash64("v"))
    shards, blocks = (max(1, -(-df.count() // size)) for df, size in ((x, shard_rows), (q, block_rows)))
    deal = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(n)).cast("int")
    x = x.withColumn("shard", deal(shards, 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    q = q.withColumn("block", deal(blocks, 2)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = q.groupBy("block", "shard").cogroup(x.groupBy("block", "shard")).applyInArrow(_search(k), "query_id long, of long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "of").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
