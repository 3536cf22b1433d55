"""Quality classifier: random-indexing vectors pooled per document, a two-layer network, a calibrated temperature.

Words and word shapes (case, length, marks around and inside, repeats of the word before)
each have a sparse random index vector made from their hash. Over all documents, a word's
context vector is the sum of the index vectors of its neighbours, two on either side; words
share BUCKETS context vectors by hash, shapes SHAPES, so tables have one size whatever the
corpus. Tasks sum their own tables; the sums meet by table slice. A document is the mean of
its words' and of its shapes' vectors (index plus unit context vector) with the logarithm
of its length. A two-layer numpy network learns from the vectors of at most ``sample``
labelled documents (those with the smallest hashes of their ids, a documented bound), and
one temperature is fitted on a tenth of them that the network did not see.

Scores depend on the text alone. Defined cases: null text counts as empty; an empty text has
the zero vector and the network's score for it; labels other than 0 and 1 or null are not
used, and of repeated labels of an id the smallest counts; with no labels of both kinds
every score is 0.5; repeated rows are scored as rows; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.llm import _text as tx

DIM, BUCKETS, SHAPES, SLICES = 32, 1 << 14, 1 << 10, 32
PARTS = 512  # groups of tasks whose tables are added first
REACH = 2  # neighbours on either side
GATHER = 400_000  # words whose neighbours are counted at once

_KIND = np.zeros(256, np.uint8)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[0x80:] = 4


def _index(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places and their signs for each hash: its sparse random index vector."""
    x = tx.mix(h ^ np.uint64(0x1F83D9ABFB41BD6B))
    place = np.stack([x % np.uint64(DIM), (x >> np.uint64(20)) % np.uint64(DIM)], 1).astype(np.int64)
    sign = np.stack([(x >> np.uint64(40)) & np.uint64(1), (x >> np.uint64(41)) & np.uint64(1)], 1).astype(np.float32) * 2 - 1
    return place, sign


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word bucket, shape) of every word of a block."""
    doc, s, e, h = tx.words(data, off)
    if not len(s):
        return doc, h.astype(np.int64), h.astype(np.int64)
    kind = _KIND[data]
    upper = np.concatenate([[0], np.cumsum(kind == 2)])
    mark = np.concatenate([[0], np.cumsum(kind == 0)])
    size, ups, marks = e - s, upper[e] - upper[s], mark[e] - mark[s]
    same = np.zeros(len(h), np.int64)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    tail = np.where(kind[e - 1] == 0, data[e - 1], 0).astype(np.int64)
    before = np.where((size > 1) & (kind[np.maximum(e - 2, 0)] == 0), 1, 0)
    shape = np.minimum(size, 12) + 13 * (kind[s] == 2) + 26 * np.minimum(ups, 3) + 104 * np.minimum(marks, 3) + 416 * same + 832 * before + 1664 * tail
    shape = (tx.mix(shape.astype(np.uint64)) % np.uint64(SHAPES)).astype(np.int64)
    return doc, (h % np.uint64(BUCKETS)).astype(np.int64), shape


def _sums(text: str):
    """Each task's context sums, words' and shapes' tables one after the other, in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS + SHAPES) * DIM, np.float64)
        held: list = []
        n = 0

        def count() -> None:
            nonlocal held, n, total
            doc, word, shape = (np.concatenate([x[k] for x in held]) for k in range(3))
            for token, base in ((word, 0), (shape, BUCKETS)):
                place, sign = _index(token.astype(np.uint64) + np.uint64(base))
                at, value = [], []
                for d in range(1, REACH + 1):
                    near = doc[d:] == doc[:-d]
                    for a, b in ((slice(d, None), slice(None, -d)), (slice(None, -d), slice(d, None))):
                        for k in range(2):
                            at.append(((token[a] + base) * DIM + place[b][:, k])[near])
                            value.append(sign[b][:, k][near])
                total += np.bincount(np.concatenate(at), np.concatenate(value), len(total))
            held, n = [], 0

        first = 0
        for batch in batches:
            data, off = tx.utf8(batch.column(text))
            for _, hi, d, o in tx.blocks(data, off):
                doc, word, shape = tokens(d, o)
                held.append((doc + first, word, shape))
                first += hi
                n += len(doc)
                if n >= GATHER:
                    count()
        if held:
            count()
        step = len(total) // SLICES
        for k in range(SLICES):
            raw = zlib.compress(total[k * step : (k + 1) * step].astype(np.int64).tobytes(), 1)
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "part": pa.array([TaskContext.get().partitionId() % PARTS], pa.int32()), "raw": pa.array([raw], pa.binary())})

    return run


def _added(key: tuple, rows: pa.Table) -> pa.Table:
    total = None
    for raw in rows["raw"]:
        x = np.frombuffer(zlib.decompress(raw.as_buffer()), np.int64)
        total = x.copy() if total is None else total + x
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "raw": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def word_vectors(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the word buckets and the shapes: index plus unit context vector, learned from all documents."""
    # Tasks' tables meet by slice and part of the tasks first, so that no group holds a slice of all tasks.
    rows = docs.select(text).mapInArrow(_sums(text), "slice int, part int, raw binary")
    for keys in (["slice", "part"], ["slice"]):
        rows = rows.groupBy(*keys).applyInArrow(_added, "slice int, raw binary")
    rows = rows.collect()
    total = np.zeros((BUCKETS + SHAPES, DIM), np.float32)
    flat = total.reshape(-1)
    step = len(flat) // SLICES
    for r in rows:
        flat[r.slice * step : (r.slice + 1) * step] = np.frombuffer(zlib.decompress(bytes(r.raw)), np.int64)
    total /= np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    place, sign = _index(np.arange(BUCKETS + SHAPES, dtype=np.uint64))
    for k in range(2):
        np.add.at(total, (np.arange(len(total)), place[:, k]), sign[:, k])
    return total[:BUCKETS], total[BUCKETS:]


def pooled(data: np.ndarray, off: np.ndarray, vectors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One vector per document of a block."""
    n = len(off) - 1
    out = np.zeros((n, 2 * DIM + 1), np.float32)
    doc, word, shape = tokens(data, off)
    if len(doc):
        count = np.bincount(doc, minlength=n)
        has = np.flatnonzero(count)
        begin = np.searchsorted(doc, has)
        out[has, :DIM] = np.add.reduceat(vectors[0][word], begin, 0) / count[has, None]
        out[has, DIM : 2 * DIM] = np.add.reduceat(vectors[1][shape], begin, 0) / count[has, None]
        out[:, -1] = np.log1p(count)
    return out


@dataclass
class Network:
    """relu(x a + b) c + d over standardised x, divided by a temperature."""

    mean: np.ndarray
    sd: np.ndarray
    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(((x - self.mean) / self.sd) @ self.a + self.b, 0) @ self.c + self.d

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> Network:
    """Adam on the logistic loss; the temperature by the best loss on a held-back tenth."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    back, own = order[: len(x) // 10], order[len(x) // 10 :]
    mean, sd = x[own].mean(0), x[own].std(0) + 1e-6
    w = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    z = (x - mean) / sd
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(own), max(1, len(own) // 128)):
            hid = np.maximum(z[part] @ w[0] + w[1], 0)
            err = (1 / (1 + np.exp(-np.clip(hid @ w[2] + w[3], -50, 50))) - y[part]) / len(part)
            back_hid = np.outer(err, w[2]) * (hid > 0)
            grad = [z[part].T @ back_hid + decay * w[0], back_hid.sum(0), hid.T @ err + decay * w[2], np.array([err.sum()])]
            t += 1
            for k, g in enumerate(grad):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, sd, w[0], w[1], w[2], float(w[3][0]))
    if len(back):
        raw, sign = net.logit(x[back]), 2 * y[back] - 1
        grid = np.geomspace(0.25, 8, 61)
        net.temperature = float(grid[int(np.argmin([np.logaddexp(0, -sign * raw / g).mean() for g in grid]))])
    return net


def _pool(held, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tx.utf8(batch.column(text))
            rows = [v.tobytes() for _, _, d, o in tx.blocks(data, off) for v in pooled(d, o, held.value)]
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(rows, pa.binary())], ["quality", "vector"])

    return run


def _score(held, text: str, to: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = held.value
        for batch in batches:
            data, off = tx.utf8(batch.column(text))
            x = [pooled(d, o, vectors) for _, _, d, o in tx.blocks(data, off)]
            score = (net.score(np.concatenate(x)) if net else np.full(len(batch), 0.5)) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score.astype(np.float64))], [*batch.schema.names, to])

    return run


def held_out(key: str = "doc_id"):
    """Rows that no label is learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, key: str = "doc_id", text: str = "text") -> tuple[tuple[np.ndarray, np.ndarray], Network | None]:
    """Word vectors from all docs, and the network from at most ``sample`` labelled ones that are not held out."""
    spark = docs.sparkSession
    vectors = word_vectors(docs, text)
    known = labels.where(F.col("quality").isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg(F.min("quality").cast("int").alias("quality"))
    known = known.orderBy(F.xxhash64(key), key).limit(sample)
    rows = docs.select(key, text).join(F.broadcast(known), key).select("quality", text)
    own = rows.mapInArrow(_pool(spark.sparkContext.broadcast(vectors), text), "quality int, vector binary")
    got = own.orderBy(F.xxhash64("vector")).limit(sample).collect()
    x = np.array([np.frombuffer(bytes(r.vector), np.float32) for r in got], np.float64)
    y = np.array([r.quality for r in got], np.float64)
    return vectors, fit(x, y) if len(set(y)) == 2 else None


def score(docs: DataFrame, labels: DataFrame, sample: int = 20_000, key: str = "doc_id", text: str = "text", to: str = "score") -> DataFrame:
    """The rows of docs, all columns, with ``to`` (in place of a column of that name): the calibrated probability of quality 1."""
    model = train(docs, labels, sample, key, text)
    docs = docs.drop(to)
    schema = T.StructType([*docs.schema, T.StructField(to, T.DoubleType())])
    return docs.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), text, to), schema)


def report(scored: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted."""
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
