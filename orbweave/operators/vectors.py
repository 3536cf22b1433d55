"""Vector search by an inverted file: postings of the nearest centroid, probes of the nearest lists, exact scores.

Centroids are fitted on a bounded sample (``sample`` rows at most); every vector is then indexed. A query asks the ``probes`` lists whose centroids
are nearest; with all lists probed the answer is exact. Lists are dealt to blocks of ``block`` vectors, so that a hot list is many tasks, and
a block's scores are one product of matrices.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, or have another length than the most frequent one
(ties to the longer), take no part; rows that repeat an id are candidates each; a query finds no row of its own id; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.sources.io import materialized


def _units(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v: vectors of length 1."""
    v = F.transform(vector, lambda x: x.cast("double"))
    fit = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    out = df.where(F.col(key).isNotNull() & fit).select(F.col(key).cast("long").alias("id"), v.alias("v"), norm.alias("_n")).where((F.col("_n") > 0) & (F.col("_n") < float("inf")))
    return out.select("id", F.transform("v", lambda x: x / F.col("_n")).alias("v"))


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), width)


class Index:
    """Postings of all vectors by the nearest of ``lists`` centroids."""

    def __init__(self, vectors: DataFrame, key: str, vector: str, lists: int = 64, sample: int = 20_000, rounds: int = 8, block: int = 4096) -> None:
        self.key, self.vector, self.block = key, vector, block
        units = materialized(_units(vectors, key, vector))
        size = units.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("w")).first()
        self.width = size["w"] if size else 0
        units = units.where(F.size("v") == self.width)
        n = size["n"] if size else 0
        drawn = units.where(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // sample)))) == 0).orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()  # at most ``sample`` rows
        self.centroids = self._fitted(np.array([r["v"] for r in drawn], np.float64).reshape(len(drawn), self.width), lists, rounds)
        self.postings = materialized(self._listed(units, 1).select("id", "v", F.col("lists")[0].alias("list")))
        sizes = self.postings.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        self.sizes = materialized(sizes)

    @staticmethod
    def _fitted(x: np.ndarray, lists: int, rounds: int) -> np.ndarray:
        """Centroids of unit vectors, from evenly spaced rows of the sample; lists that lose all their rows stay where they were."""
        if not len(x):
            return x
        c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
        for _ in range(rounds):
            own = (x @ c.T).argmax(1)
            sums = np.zeros_like(c)
            np.add.at(sums, own, x)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(norm > 0, sums / np.maximum(norm, 1e-300), c)
        return c

    def _listed(self, units: DataFrame, probes: int) -> DataFrame:
        """Rows with ``lists``: the nearest centroids, the nearest first."""
        c, width = self.centroids, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = np.argsort(-(_matrix(batch.column("v"), width) @ c.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(list(near), pa.list_(pa.int32()))], ["id", "v", "lists"])

        return units.mapInArrow(run, "id long, v array<double>, lists array<int>")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, least: float | None = None) -> DataFrame:
        """query_id, rank, id, similarity: the k most similar rows of the probed lists (all lists if None), of cosine ``least`` or more."""
        width = self.width
        q = _units(queries, self.key, self.vector).where(F.size("v") == width)
        q = self._listed(q, len(self.centroids) if probes is None else probes).select("id", "v", F.explode("lists").alias("list")).join(self.sizes, "list")
        q = q.select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("id").alias("query_id"), "v")
        p = self.postings.join(self.sizes, "list").select("list", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int").alias("block"), "id", "v")
        floor = -2.0 if least is None else least

        def best(key: tuple, own: pa.Table, rows: pa.Table) -> pa.Table:
            out = [[], [], []]
            if len(own) and len(rows):
                ids, x = rows["id"].to_numpy(), _matrix(rows["v"].combine_chunks(), width)
                names = own["query_id"].to_numpy()
                for lo in range(0, len(own), 512):
                    scores = _matrix(own["v"].slice(lo, 512).combine_chunks(), width) @ x.T
                    for name, s in zip(names[lo : lo + 512], scores):
                        at = np.flatnonzero((ids != name) & (s >= floor))
                        at = at[np.lexsort((ids[at], -s[at]))[:k]]
                        for c, v in zip(out, (np.full(len(at), name), ids[at], s[at])):
                            c.append(v)
            kinds = (np.int64, np.int64, np.float64)
            return pa.table({n: pa.array(np.concatenate(c) if c else np.zeros(0, t)) for n, c, t in zip(("query_id", "id", "similarity"), out, kinds)})

        found = q.groupBy("list", "block").cogroup(p.groupBy("list", "block")).applyInArrow(best, "query_id long, id long, similarity double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """n, recall: how many of the exact answers (query_id, id) were found."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("_hit")), ["query_id", "id"], "left")
    return hit.agg(F.count("*").alias("n"), F.coalesce(F.sum("_hit") / F.count("*"), F.lit(0.0)).alias("recall"))
