"""Vector code compression: product codes whose nearest entries are found by annular norm pruning.

Components are floored to integers, vectors are cut into equal parts, and each part position
has a codebook that begins as that part of the first vectors and moves for some rounds to
the floored means of what is assigned to each entry. A codebook's entries are sorted by norm. An entry nearer
than the best distance so far has a norm within that distance of the part's own, so two
binary searches give the annulus that can still hold a nearest entry; it is evaluated
outwards from the part's norm in exact integers, borders included, and shrinks whenever a
nearer entry is found. Entries outside cannot be nearer or equal, so ties go to the lower index among all.

A round is one pass over the vectors; tasks give the sums and counts of each entry, which
Spark adds up, so what comes to the driver is one codebook (``entries`` times the width of a vector),
whatever the table's size. Assigning compares nothing among vectors: a common vector or label is no hot group.

Integers of any length keep the results exact: parts of small integers are handled in 64 bits, others as whole numbers
of any length. Components beyond 64 bits count as the nearest 64-bit integer, as do errors.

Defined cases: vectors that are null or hold null or non-finite components are dropped;
shorter vectors count as filled up with zeros to the longest one's length, rounded up to a
multiple of the number of parts; the first vectors are those of the smallest ids, equal ids
by their components, null ids last; with fewer vectors than entries codebooks are shorter; null
labels are a label of their own; repeated rows are rows each; an empty table gives an empty
result; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm._io import answered, cut
from orbweave.llm.topk import quantized

MOST = (1 << 63) - 1
CELLS = 1 << 20  # components handled at once
EXACT = 1 << 62  # squares that stay below it are summed in 64 bits


def _norms(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) if squares.dtype != object else np.array([math.sqrt(s) for s in squares], np.float64)


class Codebook:
    """The entries of one part position, sorted by norm."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        norms = _norms(_squared(entries))
        self.order = np.lexsort((np.arange(len(entries)), norms))
        self.ring = norms[self.order]

    def _within(self, norm: np.ndarray, squared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last (exclusive) place in the ring of norms that an entry as near as ``squared`` can have."""
        reach = _norms(squared)
        reach = reach + 1e-9 * (reach + norm + 1)  # above what rounding can take away
        return np.searchsorted(self.ring, norm - reach, "left"), np.searchsorted(self.ring, norm + reach, "right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row: the index of its nearest entry, the squared distance, and how many entries were evaluated."""
        norm = _norms(_squared(x))
        start = np.minimum(np.searchsorted(self.ring, norm), len(self.ring) - 1)
        index = self.order[start]
        best = _squared(x - self.entries[index])
        low, high = self._within(norm, best)
        count = np.ones(len(x), np.int64)
        for step in range(1, len(self.ring)):
            for side in (-step, step):
                at = start + side
                rows = np.flatnonzero((at >= low) & (at < high))
                if not len(rows):
                    continue
                entry = self.order[at[rows]]
                far = _squared(x[rows] - self.entries[entry])
                count[rows] += 1
                better = (far < best[rows]) | ((far == best[rows]) & (entry < index[rows]))
                rows, entry, far = rows[better.astype(bool)], entry[better.astype(bool)], far[better.astype(bool)]
                best[rows], index[rows] = far, entry
                low[rows], high[rows] = self._within(norm[rows], far)
            if not ((start - step > low) | (start + step < high - 1)).any():
                break
        return index, best, count


def _squared(x: np.ndarray) -> np.ndarray:
    """Squared lengths of the rows."""
    return (x * x).sum(1) if x.shape[1] else np.zeros(len(x), np.int64)


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` components, filled up with zeros."""
    flat, size = col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy())
    if (size == width).all():
        return flat.reshape(len(col), width)
    out = np.zeros((len(col), width), np.int64)
    out[np.repeat(np.arange(len(col)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


class Coder:
    """Codebooks of all part positions: ``books`` is a list (part) of lists (entry) of integers."""

    def __init__(self, books: list[list[list[int]]]) -> None:
        self.parts, self.wide = len(books), len(books[0][0])
        self.width = self.parts * self.wide
        whole = np.array(books, dtype=object).reshape(self.parts, len(books[0]), self.wide)
        self.most = max((abs(c) for c in whole.flat), default=0)
        self.small = [Codebook(b.astype(np.int64)) for b in whole] if self._fits(self.most) else None
        self.books = whole

    def _fits(self, most: int) -> bool:
        return (2 * most) ** 2 * max(1, self.width) < EXACT

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row: the entry of each part, the distances summed over parts, and how many entries were evaluated."""
        fits = self.small is not None and self._fits(max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))))
        books = self.small if fits else [Codebook(b) for b in self.books]
        x = x if fits else x.astype(object)
        index, error, count = np.zeros((len(x), self.parts), np.uint8), 0, 0
        for p, book in enumerate(books):
            index[:, p], far, n = book.nearest(x[:, p * self.wide : (p + 1) * self.wide])
            error, count = error + far, count + n
        return index, np.array([min(int(e), MOST) for e in error], np.int64), count


def _assigned(batches: Iterator[pa.RecordBatch], coder: Coder, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, tuple]]:
    rows = max(1, CELLS // max(1, coder.width))
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            part = batch.slice(lo, rows)
            x = _matrix(part.column(column), coder.width)
            yield part, x, coder.assign(x)


def _sums(books: list[list[list[int]]]):
    """part, entry, place, total and n over the rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(books)
        parts, entries, wide = coder.books.shape
        total = np.zeros((parts, entries, wide), object)
        n = np.zeros((parts, entries), np.int64)
        for _, x, (index, _, _) in _assigned(batches, coder, "v"):
            limit = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
            for p in range(parts):
                own = np.zeros((entries, wide), np.int64 if limit * len(x) < MOST else object)
                np.add.at(own, index[:, p], x[:, p * wide : (p + 1) * wide].astype(own.dtype))
                total[p] += own
                n[p] += np.bincount(index[:, p], minlength=entries)
        p, e, k = (c.reshape(-1) for c in np.indices((parts, entries, wide)))
        used = np.repeat(n.reshape(-1), wide) > 0
        yield pa.RecordBatch.from_arrays([
            pa.array(p[used], pa.int32()), pa.array(e[used], pa.int32()), pa.array(k[used], pa.int32()),
            pa.array([int(v) for v in total.reshape(-1)[used]], pa.decimal128(38, 0)), pa.array(np.repeat(n.reshape(-1), wide)[used], pa.int64()),
        ], ["part", "entry", "place", "total", "n"])

    return run


def _moved(kept: DataFrame, books: list[list[list[int]]]) -> list[list[list[int]]]:
    """The codebooks after one round; entries without vectors stay."""
    sums = kept.select("v").mapInArrow(_sums(books), "part int, entry int, place int, total decimal(38,0), n long")
    out = [[list(e) for e in b] for b in books]
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("n").alias("n")).collect():
        out[r["part"]][r["entry"]][r["place"]] = int(r["total"]) // r["n"]
    return out


def train(kept: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> list[list[list[int]]]:
    """Codebooks of the vectors ``v`` (arrays of long) of kept, by part, entry and position; empty if there are none."""
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return []
    wide = -(-longest // parts)
    first = [[*r["v"], *[0] * (parts * wide - len(r["v"]))] for r in kept.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()]
    books = [[v[p * wide : (p + 1) * wide] for v in first] for p in range(parts)]
    for _ in range(rounds):
        books = _moved(kept, books)
    return books


_CODES = "vec_id long, label string, code string, error long, evaluated long"


def encode(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Of each vector kept: vec_id, code (two hex digits a part), error, evaluated (entries whose distance was computed), label_error and codebooks_sha256."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must be between 1 and 256")
    kept = cut(vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), quantized(vector, scale).alias("v")).where("v IS NOT NULL"))
    books = train(kept, parts, entries, rounds)
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, (index, error, count) in _assigned(batches, Coder(books), "v") if books else ():
            code = [row.tobytes().hex() for row in index]
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(code, pa.string()), pa.array(error), pa.array(count, pa.int64())], ["vec_id", "label", "code", "error", "evaluated"])

    coded = cut(kept.mapInArrow(run, _CODES))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = cut(coded.groupBy("label").agg(F.least(total, F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"), F.count("*").alias("n")))
    return answered(coded, sums, "label", "label_error").select("vec_id", "code", "error", "evaluated", "label_error", F.lit(digest).alias("codebooks_sha256"))
