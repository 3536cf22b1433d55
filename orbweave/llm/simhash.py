"""SimHash near-duplicates through an inverted index of byte positions with count filtering.

A text's fingerprint has 64 bits: a bit is 1 if it is set in over half of the XXH64 hashes
of its word shingles. Texts link where their fingerprints differ in ``radius`` bits at
most. So many bits lie in at most as many of the eight bytes, so linked fingerprints share
at least 8 - radius bytes at their places: the guaranteed minimum of the count filter.

Postings of single bytes would each hold a 256th of all fingerprints. The index therefore
holds their intersections: lists of the fingerprints that share ``depth`` bytes at given
places. Among the first radius + depth places a linked pair shares at least ``depth``, so
the sets of ``depth`` of those places (35 for radius 4 and depth 3) miss no pair, and a list
holds a 2^24th of unrelated fingerprints. In a list the shared bytes of each pair are tallied, pairs that
reach the minimum are kept, and their bits are compared; a pair is given by the first
of the lists that it meets in.

Only distinct fingerprints are indexed, so copies cost nothing. Longer lists are families of near copies;
in them it suffices to connect: the fingerprints within the radius of a pivot are linked to
it and not compared with each other, and what is left apart is compared with all that
belongs elsewhere. Lists over BLOCK are dealt to blocks, first each on its own; then, only
where a list still has several components, pairs of blocks, comparing across components. Members of one
component are never paired, and fingerprints that no link joins are the only ones whose cost is the square of a list.

Defined cases: words are runs of bytes outside [\\x20\\x09-\\x0D], A-Z lower-cased; shingles
count as often as they occur; fewer words are one shingle; texts that are null or hold no
words have fingerprint zero and link like any other; null ids take part, and a component of
null ids alone has a null id; repeated rows are rows each; an empty table gives an empty result;
other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm._io import answered, cut
from orbweave.llm.components import components

STRETCH = 1 << 15  # shingles whose bits are counted at once
FEW = 64  # lists up to this are compared pair by pair
BLOCK = 1 << 16
CELLS = 1 << 21  # cells of a matrix of distances


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The fingerprint of one text as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole, digest = b" ".join(words), xxhash.xxh64_digest
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[: len(ends) - width])]
    ends = ends[width - 1 :] or ends[-1:]
    set_in = np.zeros(64, np.int64)
    for k in range(0, len(ends), STRETCH):
        raw = b"".join([digest(whole[a:b], seed) for a, b in zip(starts[k : k + STRETCH], ends[k : k + STRETCH])])
        set_in += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_in > len(ends)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t.as_py(), width, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, fp long")


def _masks(radius: int, depth: int) -> list[int]:
    """Sets of ``depth`` byte places of the first radius + depth, as masks of 64 bits."""
    if not 0 <= radius < 8 or not 1 <= depth <= 8 - radius:
        raise ValueError("radius must be below 8 and depth between 1 and 8 - radius")
    return [sum(0xFF << 8 * p for p in places) for places in combinations(range(radius + depth), depth)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def postings(prints: DataFrame, radius: int = 4, depth: int = 3) -> DataFrame:
    """The inverted index of distinct fingerprints ``fp``: places (which set of byte places), shared (their bytes), fp."""
    lists = F.array(*(F.struct(F.lit(k).cast("byte").alias("places"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("shared")) for k, m in enumerate(_masks(radius, depth))))
    return prints.select("fp", F.explode(lists).alias("x")).select("x.places", "x.shared", "fp")


def _near(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= radius


def _tallied(x: np.ndarray, places: np.ndarray, size: np.ndarray, masks: np.ndarray, radius: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of short lists that lie one after another; size: how many of a row's list follow from it on."""
    out, at, step = [], np.flatnonzero(size > 1), 1
    byte = np.uint64(0xFF) << (np.arange(8, dtype=np.uint64) * np.uint64(8))
    while len(at):
        for lo in range(0, len(at), CELLS // 8):
            a = at[lo : lo + CELLS // 8]
            diff = x[a] ^ x[a + step]
            shared = (diff[:, None] & byte) == 0
            keep = np.flatnonzero(shared.sum(1) >= 8 - radius)
            keep = keep[np.bitwise_count(diff[keep]) <= radius]
            first = shared[keep, : radius + depth]
            first &= np.cumsum(first, axis=1) <= depth
            mine = (first * byte[: radius + depth]).sum(1, dtype=np.uint64) == masks[places[a[keep]]]
            out.append(a[keep[mine]])
            out.append(a[keep[mine]] + step)
        step += 1
        at = at[size[at] > step]
    none = np.zeros(0, np.int64)
    return (np.concatenate([none, *out[::2]]), np.concatenate([none, *out[1::2]]))


def across(x: np.ndarray, label: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of links between different labels: of each row, one to each label that it reaches."""
    classes, code, size = np.unique(label, return_inverse=True, return_counts=True)
    if len(classes) < 2:
        return
    rest = np.flatnonzero(code != size.argmax())
    rows = max(1, CELLS // len(x))
    for lo in range(0, len(rest), rows):
        own = rest[lo : lo + rows]
        a, b = np.nonzero(_near(x[own][:, None], x[None, :], radius) & (code[own][:, None] != code[None, :]))
        first = np.unique(a * len(classes) + code[b], return_index=True)[1]
        yield own[a[first]], b[first]


def connected(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of links that connect all that links within the radius connect."""
    label, covered, pivot = np.arange(len(x)), np.zeros(len(x), bool), np.zeros(len(x), bool)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while not covered.all():
        p = int(covered.argmin())
        near = np.flatnonzero(_near(x, x[p], radius))
        pivot[p] = covered[near] = True
        held, first = np.unique(label[near], return_index=True)
        if len(held) > 1:
            b.append(near[first])
            a.append(np.full(len(first), p))
            label[near] = held[0]
            label[np.isin(label, held)] = held[0]
    left = np.flatnonzero(~pivot)
    for c, d in across(x[left], label[left], radius):
        a.append(left[c])
        b.append(left[d])
    return np.concatenate(a), np.concatenate(b)


_EDGES = "a long, b long"


def _edges(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    a, b = x[a].view(np.int64), x[b].view(np.int64)
    keep = a != b
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)[keep]), pa.array(np.minimum(a, b)[keep])], ["a", "b"])


def _lists(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of runs of whole lists, and where each list begins (and the last ends); a list is what agrees in the first ``keys`` columns."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        last = [c[-1] for c in new[:keys]]
        cut_at = max((int(np.flatnonzero(c != v)[-1]) + 1 for c, v in zip(new, last) if (c != v).any()), default=0)
        if not cut_at and held and all(h[-1] == v for h, v in zip(held[-1], last)):
            held.append(new)
            continue
        if not cut_at:
            yield _bounded([np.concatenate(c) for c in zip(*held)], keys) if held else ([], np.zeros(1, np.int64))
            held = [new]
            continue
        held.append([c[:cut_at] for c in new])
        yield _bounded([np.concatenate(c) for c in zip(*held)], keys)
        held = [[c[cut_at:] for c in new]]
    if held:
        yield _bounded([np.concatenate(c) for c in zip(*held)], keys)


def _bounded(columns: list[np.ndarray], keys: int) -> tuple[list[np.ndarray], np.ndarray]:
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.any([c[1:] != c[:-1] for c in columns[:keys]], axis=0)
    return columns, np.append(np.flatnonzero(new), n)


def _links(radius: int, depth: int):
    """Rows (places, shared, block, fp) in order: the links in each list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = np.array(_masks(radius, depth), np.uint64)
        for columns, edge in _lists(batches, 3):
            if not columns:
                continue
            x, count = columns[3].view(np.uint64), np.diff(edge)
            size = np.repeat(edge[1:], count) - np.arange(len(x))
            short = np.repeat(count <= FEW, count)
            yield _edges(x, *_tallied(x, columns[0], np.where(short, size, 0), masks, radius, depth))
            for k in np.flatnonzero(count > FEW):
                own = x[edge[k] : edge[k + 1]]
                yield _edges(own, *connected(own, radius))

    return run


def _cross_links(radius: int):
    """Rows (places, shared, i, j, fp, component) in order: links between components of a pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, edge in _lists(batches, 4):
            for lo, hi in zip(edge, edge[1:]) if columns else ():
                own = columns[4][lo:hi].view(np.uint64)
                for a, b in across(own, columns[5][lo:hi], radius):
                    yield _edges(own, a, b)

    return run


def _met(index: DataFrame, keys: tuple[str, ...], run, more: tuple[str, ...] = ()) -> DataFrame:
    return cut(index.select(*keys, *more).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, _EDGES))


def clusters(prints: DataFrame, radius: int = 4, depth: int = 3, block: int = BLOCK) -> DataFrame:
    """(id, component) of the distinct fingerprints ``fp`` that have a link, by the smallest fingerprint of each component."""
    index = postings(prints, radius, depth)
    long_ = cut(index.groupBy("places", "shared").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1"))
    deal = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = index.join(long_, ["places", "shared"], "left").withColumn("block", F.coalesce(deal, F.lit(0)))
    links = _met(dealt, ("places", "shared", "block"), _links(radius, depth), ("fp",))
    found = components(links)
    if long_.isEmpty():
        return found
    apart = index.join(long_, ["places", "shared"]).join(found.withColumnRenamed("id", "fp"), "fp", "left")
    apart = cut(apart.select("places", "shared", "blocks", deal.alias("block"), "fp", F.coalesce("component", "fp").alias("component")))
    several = apart.groupBy("places", "shared").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("places", "shared")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = apart.join(several, ["places", "shared"]).select("*", other).where("block <> other")
    pairs = pairs.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    more = _met(pairs, ("places", "shared", "i", "j"), _cross_links(radius), ("fp", "component"))
    return found if more.isEmpty() else components(links.unionAll(more))


def classes(docs: DataFrame, width: int = 4, radius: int = 4, depth: int = 3, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links reach."""
    rows = cut(fingerprints(docs, width, seed))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    found = clusters(distinct.select("fp"), radius, depth, block).withColumnRenamed("id", "fp")
    each = cut(distinct.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    least = each.groupBy("component").agg(F.min("least").alias("component_id"))
    answers = cut(each.join(least, "component").select("fp", "n", "component_id"))
    out = answered(rows, answers, "fp", "component_id")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
