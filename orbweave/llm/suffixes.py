"""Suffix-array dedup: every byte covered by a long string that also starts anywhere else.

Copies of one text are one text. A string of ``span`` bytes holds in each copy the same
anchor: its K-gram with the smallest hash. Documents are cut into runs of starting places
with one anchor value; a run's context is the bytes from its first start to the end of its last
string. Equal strings lie in runs with equal anchors, so runs whose anchor occurs in no other
place are done, and the contexts of each other anchor meet in a shard; equal contexts are one.

A shard joins its contexts to one text and sorts its suffixes by Larsson-Sadakane
refinement in numpy: ranks by the first 8 bytes, then by pairs of ranks, doubling, always
only for suffixes that still share a rank, until span bytes are compared. Kasai's rule
(the prefix shared with the next smaller suffix shrinks by one at most from a place to
the next) gives the common prefixes: they are measured where the bytes before two suffixes
differ and follow from there elsewhere. Starts whose prefix with a neighbour reaches span
are repeated. An anchor with more contexts than a shard holds is split over several; each
shard sends one 128-bit digest for each distinct string of such an anchor, a digest's part
of the range decides where it goes, and there the shards' sorted digests are merged by binary
search; no shard sees another's text.

Defined cases: null text counts as empty; texts shorter than span lose nothing; matches never
cross documents; repeated rows are copies; rows with null ids are rows; an empty table gives
an empty result; other columns are kept by ``remove`` only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm import _text as tx
from orbweave.llm._io import cut, parts, text_key

SPAN = 400
K = 64
SHARD = 2 << 20  # bytes of contexts that a shard aims at
MANY = 4096  # contexts of one anchor that stay in one shard


def anchor_hash(data: np.ndarray, k: int = K) -> np.ndarray:
    """A hash of every run of k bytes, k a power of two, by doubling."""
    h = tx.mix(data.astype(np.uint64) + np.uint64(1))
    m, n = 0xD6E8FEB86659FD93, 1
    while n < k:
        h = h[:-n] * np.uint64(m) + h[n:]
        h ^= h >> np.uint64(31)
        m, n = m * m % (1 << 64) | 1, n * 2
    return tx.mix(h)


def runs(data: np.ndarray, off: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, ...]:
    """(document, first start in it, number of starts, anchor, whether the anchor lies in it twice) of a block's runs."""
    none = np.zeros(0, np.int64)
    if len(data) < span:
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    h = low = anchor_hash(data)
    wide, n = span - K + 1, 1
    while n * 2 <= wide:
        low = np.minimum(low[:-n], low[n:])
        n *= 2
    if rest := wide - n:
        low = np.minimum(low[:-rest], low[rest:])
    size = np.maximum(np.diff(off) - span + 1, 0)
    doc = np.repeat(np.arange(len(size)), size)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    a = low[start + off[doc]]
    if not len(a):
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])]))
    doc, start, n, a = doc[first], start[first], np.diff(np.append(first, len(a))), a[first]
    twice = np.zeros(len(a), bool)
    windows = np.lib.stride_tricks.sliding_window_view(h, span - K + 1)
    for lo in range(0, len(a), 1024):  # the leftmost place in the first window against the rightmost in the last
        part = slice(lo, lo + 1024)
        at = start[part] + off[doc[part]]
        left = at + np.argmax(windows[at] == a[part, None], 1)
        end = at + n[part] - 1
        right = end + span - K - np.argmax((windows[end] == a[part, None])[:, ::-1], 1)
        twice[part] = left != right
    return doc, start, n, a, twice


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Larsson-Sadakane to a depth: the suffixes in order and each place's rank; equal ranks share depth bytes or more."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64) + np.uint64(0), np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    rank = np.zeros(n + 1, np.int64)
    group = np.flatnonzero(new)
    rank[order] = np.repeat(group, np.diff(np.append(group, n))) + 1  # 0 lies behind the end
    h = 8
    while h < depth:
        size = np.diff(np.append(group, n))
        if not (size > 1).any():
            break
        at = np.flatnonzero(np.repeat(size > 1, size))
        place = order[at]
        own, then = rank[place], rank[np.minimum(place + h, n)]
        by = np.argsort(own * np.int64(n + 2) + then, kind="stable")
        place, own, then = place[by], own[by], then[by]
        order[at] = place
        starts = np.concatenate([[True], (own[1:] != own[:-1]) | (then[1:] != then[:-1])])
        first = at[np.flatnonzero(starts)]
        rank[place] = np.repeat(first, np.diff(np.append(np.flatnonzero(starts), len(place)))) + 1
        group = np.union1d(group, first)
        h *= 2
    return order, rank[:n]


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Kasai: for each place of the order, the prefix shared with the suffix before it, up to most bytes."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    # Where the bytes to the left of both agree the prefix is one less than the one to the left.
    follows = np.zeros(n, bool)
    b = before[1:]
    follows[1:] = (b > 0) & (text[:-1] == text[np.maximum(b - 1, 0)]) & (before[:-1] == b - 1)
    ask = np.flatnonzero(~follows & (before >= 0))
    padded = np.concatenate([text, np.zeros(1, np.uint8)])
    shared = np.zeros(n, np.int64)
    live, k = ask, 0
    while len(live):
        p, q = live + k, before[live] + k
        same = (p < n) & (q < n)
        same &= padded[np.minimum(p, n)] == padded[np.minimum(q, n)]
        live = live[same]
        shared[live] += 1
        k += 1
    source = np.where(follows, 0, np.arange(n))
    source = np.maximum.accumulate(source)
    plcp = np.maximum(shared[source] - (np.arange(n) - source), 0)
    return np.minimum(plcp, most)[order]


def repeated(contexts: list[bytes], starts: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """For contexts, of whose places the first ``starts`` count: whether the string at each also starts at another, and its class."""
    size = np.array([len(c) for c in contexts])
    at = np.cumsum(size) - size
    text = np.frombuffer(b"".join(contexts), np.uint8)
    order, rank = suffix_array(text, span)
    lcp = common_prefixes(text, order, span)
    doc = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(text)) - at[doc]
    counts = place < starts[doc]
    # Runs of the order whose neighbours share span bytes; strings that leave their context don't count.
    klass = np.cumsum(lcp < span) - 1
    member = counts[order]
    many = np.bincount(klass[member], minlength=int(klass[-1]) + 1) > 1
    hit, of = np.zeros(len(text), bool), np.zeros(len(text), np.int64)
    hit[order] = many[klass] & member
    of[order] = klass
    return hit[counts], of[counts]


def _keys(cols: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(cols)


def _anchors(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tx.utf8(batch.column("text"))
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for lo, _, d, o in tx.blocks(data, off):
                doc, start, n, a, twice = runs(d, o, span)
                if len(doc):
                    yield _keys({"k1": pa.array(k1[lo + doc]), "k2": pa.array(k2[lo + doc]), "anchor": pa.array(a.view(np.int64)), "start": pa.array(start.astype(np.int32)), "n": pa.array(n.astype(np.int32)), "twice": pa.array(twice)})

    return run


def _contexts(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("k1", "k2", "anchor", "start", "n", "twice", "digest", "context")}
            for k1, k2, t, own in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text", "runs")), strict=True):
                raw = t.encode()
                for r in own:
                    c = raw[r["start"] : r["start"] + r["n"] + span - 1]
                    for to, x in zip(out.values(), (k1, k2, r["anchor"], r["start"], r["n"], r["twice"], hashlib.blake2b(c, digest_size=16).digest(), c), strict=True):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], list(out))

    return run


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _shard(span: int):
    """A shard's contexts with a bit for each start that is repeated within it; for split anchors its distinct strings' digests."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        order = np.lexsort((np.array([int.from_bytes(x[:6], "big") for x in rows["digest"].to_pylist()]), rows["anchor"].to_numpy()))
        rows = rows.take(pa.array(order))
        context, n = rows["context"].to_pylist(), rows["n"].to_numpy().astype(np.int64)
        hit, of = repeated(context, n, span)
        edges = np.concatenate([[0], np.cumsum(n)])
        split = rows["split"].to_numpy(zero_copy_only=False)
        first = np.zeros(len(of), bool)  # a string that the shard holds several times is found already; it is sent once, for the other shards
        first[np.unique(of, return_index=True)[1]] = True
        bits, strings = [], []
        for k, c in enumerate(context):
            bits.append(_bits(hit[edges[k] : edges[k + 1]]))
            own = first[edges[k] : edges[k + 1]].tolist()
            strings.append([hashlib.blake2b(c[p : p + span], digest_size=16).digest() if own[p] else None for p in range(n[k])] if split[k] else None)
        return pa.table({"anchor": rows["anchor"], "digest": rows["digest"], "n": rows["n"], "copies": rows["copies"], "bits": pa.array(bits, pa.binary()), "strings": pa.array(strings, pa.list_(pa.binary())), "shard": pa.array(np.full(len(n), key[0].as_py(), np.int64))})

    return run


def _meet(key: tuple, rows: pa.Table) -> pa.Table:
    """One part of the digests' range: those that lie in two shards or more, by binary search in each shard's sorted digests."""
    shard = rows["shard"].to_numpy()
    raw = np.array([x.as_buffer().to_pybytes() for x in rows["string"]], "S16") if len(rows) else np.zeros(0, "S16")
    lists = {s: np.unique(raw[shard == s]) for s in np.unique(shard)}
    found = np.zeros(len(raw), bool)
    for s in lists:
        own = np.flatnonzero(shard == s)
        for other, held in lists.items():
            if other != s:
                at = np.minimum(np.searchsorted(held, raw[own]), len(held) - 1)
                found[own] |= held[at] == raw[own]
    return pa.table({"anchor": rows["anchor"].filter(pa.array(found)), "digest": rows["digest"].filter(pa.array(found)), "place": rows["place"].filter(pa.array(found))})


def _spans(span: int):
    """The spans to remove of a text, from its repeated starts."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        start, n = rows["start"].to_numpy(), rows["n"].to_numpy()
        hits = []
        for s, k, bits, more in zip(start, n, rows["bits"].to_pylist(), rows["more"].to_pylist(), strict=True):
            own = np.unpackbits(np.frombuffer(bits, np.uint8))[:k].astype(bool) if bits is not None else np.ones(k, bool)
            if more:
                own[np.array(more)] = True
            hits.append(s + np.flatnonzero(own))
        at = np.unique(np.concatenate(hits))
        if not len(at):
            return pa.table({"k1": pa.array([], pa.int64()), "k2": pa.array([], pa.int64()), "spans": pa.array([], pa.binary())})
        first = np.flatnonzero(np.concatenate([[True], at[1:] - at[:-1] > span]))
        ends = at[np.append(first[1:] - 1, len(at) - 1)] + span
        pairs = np.stack([at[first], ends], 1).astype(np.int64)
        return pa.table({"k1": pa.array([key[0].as_py()]), "k2": pa.array([key[1].as_py()]), "spans": pa.array([pairs.tobytes()], pa.binary())})

    return run


def repeats(docs: DataFrame, span: int = SPAN, text: str = "text", key: str = "doc_id", many: int = MANY) -> DataFrame:
    """(k1, k2, spans): of every text (by its key) with repeated strings, byte spans as 64-bit pairs; all of it where it has copies."""
    spark = docs.sparkSession
    k1, k2 = text_key(text)
    own = docs.select(F.xxhash64(key).alias("h"), F.col(text).alias("text"), k1.alias("k1"), k2.alias("k2"))
    long_ = own.where(F.octet_length("text") >= span)
    copies = cut(long_.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("h").alias("h")))
    found = cut(long_.mapInArrow(_anchors(span), "k1 long, k2 long, anchor long, start int, n int, twice boolean"))
    each = found.groupBy("anchor", "k1", "k2", "start").agg(F.first("n").alias("n"), F.first("twice").alias("twice"))
    often = each.groupBy("anchor").agg(F.count("*").alias("often"), F.max("twice").alias("twice")).where("often > 1 OR twice").select("anchor")
    kept = cut(each.join(often, "anchor").select("anchor", "k1", "k2", "start", "n", "twice"))
    by_text = kept.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "n", "anchor", "twice")).alias("runs")).join(copies.select("k1", "k2", "h"), ["k1", "k2"])
    pick = long_.join(by_text, ["k1", "k2", "h"])  # one copy of each text, but for rows that repeat its id
    placed = cut(pick.select("k1", "k2", "text", "runs").mapInArrow(_contexts(span), "k1 long, k2 long, anchor long, start int, n int, twice boolean, digest binary, context binary"))
    places = placed.select("anchor", "digest", "k1", "k2", "start", "n").distinct()
    whole = cut(places.groupBy("anchor", "digest").agg(F.count("*").cast("int").alias("copies"), F.first("n").alias("n")).join(
        placed.groupBy("anchor", "digest").agg(F.first("context").alias("context"), F.max("twice").alias("twice")), ["anchor", "digest"]))
    # Contexts that are alone with an anchor that they hold once need no shard: their strings occur where they do.
    # Sizes are counted apart from the contexts, so that a common anchor's contexts are joined from parts of any size.
    varied = cut(whole.select("anchor", F.length("context").alias("size"), "twice").groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("size").alias("bytes"), F.max("twice").alias("any_twice")))
    rows = whole.join(varied.where("kinds > 1 OR any_twice"), "anchor")
    total = varied.where("kinds > 1 OR any_twice").agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, -(-total // SHARD))
    several = rows.where("kinds > 1 OR any_twice").withColumn("split", F.col("kinds") > many)
    sub = F.when(F.col("split"), F.pmod(F.xxhash64("digest"), F.ceil(F.col("kinds") / many))).otherwise(0)
    several = several.withColumn("shard", F.when(F.col("split"), F.xxhash64("anchor", sub)).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards))))
    done = cut(several.select("shard", "anchor", "digest", "context", "n", "copies", "split").groupBy("shard").applyInArrow(_shard(span), "anchor long, digest binary, n int, copies int, bits binary, strings array<binary>, shard long"))
    strings = done.where("strings IS NOT NULL").select("anchor", "digest", "shard", F.posexplode("strings").alias("place", "string")).where("string IS NOT NULL")
    ranges = parts(spark, 8) * 8
    met = strings.groupBy(F.pmod(F.xxhash64("string"), F.lit(ranges)).alias("range")).applyInArrow(_meet, "anchor long, digest binary, place int")
    more = met.groupBy("anchor", "digest").agg(F.collect_list("place").alias("more"))
    hits = done.select("anchor", "digest", "n", "bits").join(more, ["anchor", "digest"], "left")
    every = whole.where("copies > 1").select("anchor", "digest", "n", F.lit(None).cast("binary").alias("bits"), F.lit(None).cast("array<int>").alias("more"))
    marked = places.drop("n").join(hits.unionAll(every), ["anchor", "digest"])
    spans = marked.groupBy("k1", "k2").applyInArrow(_spans(span), "k1 long, k2 long, spans binary")
    full = copies.where("copies > 1").select("k1", "k2", F.lit(None).cast("binary").alias("spans"))
    return spans.join(full.select("k1", "k2"), ["k1", "k2"], "left_anti").unionAll(full)


def _cut_out(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_bytes, n_removed, n_spans = [], [], [], []
            for t, hit, spans in zip(*(batch.column(c).to_pylist() for c in ("_text", "_hit", "_spans")), strict=True):
                raw = (t or "").encode()
                pairs = [] if not hit else [(0, len(raw))] if spans is None else np.frombuffer(spans, np.int64).reshape(-1, 2).tolist()
                parts_, at = [], 0
                for a, b in pairs:
                    parts_.append(raw[at:a])
                    at = b
                kept.append(b"".join([*parts_, raw[at:]]) if pairs else raw)
                n_bytes.append(len(raw))
                n_removed.append(len(raw) - len(kept[-1]))
                n_spans.append(len(pairs))
            names = [c for c in batch.schema.names if c[0] != "_"]
            cols = [pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *cols], [*names, "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove(docs: DataFrame, span: int = SPAN, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every row with n_bytes, n_removed, n_spans and ``kept``: the bytes that remain."""
    from pyspark.sql import types as T

    k1, k2 = text_key(text)
    found = repeats(docs, span, text, keep[0])
    rows = docs.select(*keep, F.col(text).alias("_text"), k1.alias("k1"), k2.alias("k2")).join(found.select("k1", "k2", F.col("spans").alias("_spans"), F.lit(True).alias("_hit")), ["k1", "k2"], "left").select(*keep, "_text", "_spans", "_hit")
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])
    return rows.mapInArrow(_cut_out(text), schema)


def digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
