"""Benchmark decontamination: SimHash windows, multi-index Hamming blocks, exact similarity.

A document's windows of a benchmark item's size are fingerprinted with SimHash over their
words (BITS bits). Fingerprints within RADIUS of an item's agree with it, but for EACH
bits, in one of BLOCKS blocks at least (RADIUS < BLOCKS * (EACH + 1)), so tables from a
block's value to the items nearby there find all of them. What is within the radius is
compared exactly: the items' and the window's five-word shingles as multisets, the sum of
the smaller counts over the sum of the larger. A window and an item of similarity 0.75 share
three sevenths of the shingles that they hold together, so only windows with as many places of
known shingles are fingerprinted; no other can match. The radius is a sketch's: of 240,000 simulated windows just at similarity 0.75 with all differing words at
one end (10 to 200 words, drawn alike or by Zipf's law) none left it; the farthest had 44
bits.

Words are runs of ASCII letters and digits and of non-ASCII bytes, A-Z lower-cased, so that
punctuation hides nothing. Items come to the driver and go to the tasks in blocks of at
most BLOCK_ITEMS items and BLOCK_BYTES of text (each block is one broadcast of proven size,
each a pass over the documents), so any size of benchmark works.

Defined cases: null and empty texts and items have no words and match nothing; an item of
fewer than five words is one shingle and matches its exact sequence; items with null ids
count and are found under null; a document shorter than
an item is a window of its own; repeated rows each have their results; empty tables give an
empty result; other columns are carried only by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from orbweave.llm import _text as tx

BITS, BLOCKS, EACH, RADIUS = 128, 16, 2, 47
BLOCK_ITEMS, BLOCK_BYTES = 4096, 32 << 20


def _bits(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of BITS bits of each hash."""
    two = np.stack([tx.mix(h), tx.mix(h ^ np.uint64(0x5851F42D4C957F2D))], 1)
    return np.unpackbits(two.view(np.uint8), axis=1).astype(np.int16) * 2 - 1


class Index:
    """A block of items: shingles, fingerprints and the tables of their blocks."""

    def __init__(self, ids: list[int], texts: list[str], width: int = 5) -> None:
        self.width = width
        data, off = tx.utf8(pa.array(texts, pa.large_string()))
        doc, _, _, h = tx.words(data, off, tx.NOT_ALNUM)
        at = tx.word_counts(doc, len(texts))
        keep = [k for k in range(len(texts)) if at[k + 1] > at[k]]
        self.ids = [ids[k] for k in keep]
        self.words = [h[at[k] : at[k + 1]] for k in keep]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.grams = [self._grams(w, min(width, len(w))) for w in self.words]
        self.counts = [np.unique(g, return_counts=True) for g in self.grams]
        sums = [_bits(w).sum(0) for w in self.words]
        self.prints = np.packbits(np.array(sums).reshape(len(keep), BITS) > 0, axis=1)
        #: For each width: the shingles of all items, in order.
        self.anchors = {n: np.unique(np.concatenate([g for g, w in zip(self.grams, self.words, strict=True) if min(width, len(w)) == n])) for n in {min(width, len(w)) for w in self.words}}
        step = BITS // 8 // BLOCKS
        value = np.arange(256, dtype=np.uint8)
        near = np.bitwise_count(value[:, None] ^ value[None, :]) <= EACH
        self.tables = [near[:, self.prints[:, k * step]] for k in range(BLOCKS)]

    @staticmethod
    def _grams(h: np.ndarray, width: int) -> np.ndarray:
        return tx.shingles(h, np.array([0, len(h)]), width)[0]

    def _windows(self, h: np.ndarray, grams: dict[int, np.ndarray], hit: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(item, windows, start, similarity) of each item that a document holds, with its best window."""
        total = None
        known = np.zeros(len(h) + 1, np.int64)
        known[hit + 1] = 1
        known = np.cumsum(known)
        for size in np.unique(self.sizes):
            items = np.flatnonzero(self.sizes == size)
            n = min(int(size), len(h))
            # Both hold at most as many shingles as the window has places of known ones; fewer than this cannot reach 0.75.
            width = min(self.width, int(size))
            own = max(n - width + 1, 0)
            starts = np.arange(len(h) - n + 1)
            starts = starts[7 * (known[starts + own] - known[starts]) >= 3 * (own + int(size) - width + 1)]
            if not len(starts):
                continue
            if total is None:
                total = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(_bits(h), 0, dtype=np.int32)])
            prints = np.packbits(total[starts + n] - total[starts] > 0, axis=1)
            near = reduce(np.logical_or, (t[prints[:, k]][:, items] for k, t in enumerate(self.tables)))
            w, i = np.nonzero(near)
            ok = np.bitwise_count(prints[w] ^ self.prints[items[i]]).sum(1, dtype=np.int64) <= RADIUS
            best: dict[int, tuple[int, int, float]] = {}
            for s, item in zip(starts[w[ok]], items[i[ok]], strict=True):
                if (alike := self._similar(grams, int(s), n, item)) >= 0.75:
                    count, at, most = best.get(item, (0, 0, 0.0))
                    best[item] = (count + 1, int(s), alike) if alike > most else (count + 1, at, most)
            for item, found in best.items():
                yield item, *found

    def _similar(self, grams: dict[int, np.ndarray], start: int, n: int, item: int) -> float:
        width = min(self.width, int(self.sizes[item]))
        own = grams[width][start : start + n - width + 1] if n >= width else np.zeros(0, np.uint64)
        g, c = self.counts[item]
        h, k = np.unique(own, return_counts=True)
        at = np.minimum(np.searchsorted(g, h), len(g) - 1)
        both = int(np.minimum(k, c[at])[g[at] == h].sum())
        return both / (len(own) + int(c.sum()) - both)

    def search(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(document, item, windows, start, similarity) over a block of documents."""
        doc, _, _, h = tx.words(data, off, tx.NOT_ALNUM)
        at = tx.word_counts(doc, len(off) - 1)
        hit = []
        for width, known in self.anchors.items():
            g, g_at = tx.shingles(h, at, width)
            k = np.minimum(np.searchsorted(known, g), len(known) - 1)
            p = np.flatnonzero(known[k] == g)
            d = np.searchsorted(g_at, p, "right") - 1
            p = p - g_at[d]
            whole = np.diff(at)[d] >= width
            hit.append(np.stack([d[whole], p[whole]], 1))
        hits = np.unique(np.concatenate(hit), axis=0) if hit else np.zeros((0, 2), np.int64)
        out, wide = [], int(self.sizes.max())
        for d in np.unique(hits[:, 0]):
            place = hits[hits[:, 0] == d, 1]
            found: dict[int, tuple[int, int, float]] = {}
            # Shared shingles that no window can hold together are searched apart, so that long texts stay cheap.
            for near in np.split(place, np.flatnonzero(np.diff(place) > 2 * wide) + 1):
                lo, hi = max(0, near[0] - wide), min(at[d + 1] - at[d], near[-1] + wide + self.width)
                own = h[at[d] + lo : at[d] + hi]
                for item, n, start, alike in self._windows(own, {w: self._grams(own, w) for w in self.anchors}, near - lo):
                    count, begin, most = found.get(item, (0, 0, 0.0))
                    found[item] = (count + n, start + int(lo), alike) if alike > most else (count + n, begin, most)
            out += [(int(d), item, *x) for item, x in sorted(found.items())]
        return out


def _items(benchmark: DataFrame, key: str, text: str) -> Iterator[Index]:
    ids, texts, size = [], [], 0
    for r in benchmark.select(key, text).where(F.col(text).isNotNull()).toLocalIterator():
        if ids and (len(ids) >= BLOCK_ITEMS or size + len(r[1]) > BLOCK_BYTES):
            yield Index(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1])
    index = Index(ids, texts)
    if len(index.ids):
        yield index


def _hits(held, text: str, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            data, off = tx.utf8(batch.column(text))
            got = [(lo + d, *x) for lo, _, b, o in tx.blocks(data, off) for d, *x in index.search(b, o)]
            if got:
                row, item, count, start, alike = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array([index.ids[k] for k in item], kind), pa.array(count, pa.int64()), pa.array(start, pa.int64()), pa.array(alike, pa.float64())], ["key", "item_id", "n_windows", "start", "similarity"])

    return run


def _kept(held, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            data, off = tx.utf8(batch.column(text))
            bad = {lo + d for lo, _, b, o in tx.blocks(data, off) for d, *_ in index.search(b, o)}
            yield batch.filter(pa.array([k not in bad for k in range(len(batch))])) if bad else batch

    return run


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """key, item_id, n_windows, start (in words) and similarity of the best window, for every item that a row holds."""
    spark = docs.sparkSession
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, item_id {benchmark.schema[item].dataType.simpleString()}, n_windows long, start long, similarity double"
    kind = to_arrow_type(benchmark.schema[item].dataType)
    found = [docs.select(key, text).mapInArrow(_hits(spark.sparkContext.broadcast(x), text, kind), schema.replace(key, "key", 1)).withColumnRenamed("key", key) for x in _items(benchmark, item, text)]
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no item of the benchmark."""
    spark = docs.sparkSession
    for index in _items(benchmark, item, text):
        docs = docs.mapInArrow(_kept(spark.sparkContext.broadcast(index), text), docs.schema)
    return docs
