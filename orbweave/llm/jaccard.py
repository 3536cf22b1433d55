"""Jaccard join of documents' word n-grams with PartEnum signatures.

Sets fall into bands of sizes [2^b, 2^(b+1)). The domain of shingle hashes is cut into P(b)
ranges; what a set holds in a range, hashed, is one signature, and the ranges that it
reaches are enumerated in the order of the signatures' hashes. Two sets with similarity of
at least ``num / den`` differ in at most n (den - num) / num shingles, n being the size of
either, so of any ham + 1 + x of a set's signatures at most ham are not shared; since both
sets enumerate in one order, their first ham + 1 + x signatures share x + 1 at least. A
set also enumerates for the band below where that may hold a smaller partner, so every
linked pair meets in a band (n2 = 1 second-level partitions: five-word shingles are
selective enough for single ranges, and larger subsets only add signatures).

Equal sets are one set from the start: a task sends a set's signatures once, however many
texts have it, in blobs, one for each bucket, where copies from other tasks are dropped as they
come in. A signature that at most FEW sets share gives all its pairs; a set may leave out up
to x signatures that more share. Sets of which more are common (large groups of near
copies) meet, for just the ham + 1 - (uncommon) rarest of their common signatures, a hub of
each signature first; only where the links with the hubs leave a signature's sets in
several components are the sets outside the hub's component paired with the others, and of
these pairs only those that the triangle inequality allows. Every pair that shares a needed
signature is thus compared, connected already, or provably apart. Pairs are compared on
the whole sets of shingle hashes.

Defined cases: null and empty texts have no set, size 0, and link with nothing; texts with
fewer words than an n-gram have their whole sequence as the only shingle; rows that repeat a
doc_id are nodes of their own text but share the id; rows with a null doc_id take part, and
a component's id is the smallest id that is not null; an empty table gives an empty result;
other columns are ignored. Shingles are 64-bit hashes, and so are the names of sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.llm import _text as tx
from orbweave.llm._io import cut, parts, text_key
from orbweave.llm.components import components

FEW = 24
BLOCK = 512  # sets of a block in which a family is compared
COLUMNS = 1 << 15  # shared shingles of two blocks that are counted at once
FLUSH = 1_500_000  # signatures that a task holds before it sends them on

_ROWS = "doc_id long, k1 long, k2 long, n int, sid long, keep int, keep_low int"
_BLOBS = "bucket int, band int, sigs binary, at binary, sids binary, sizes binary, slacks binary"


def sets(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct hashes in order, and where they begin."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(at)))


def names(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; 0 for an empty one."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tx.mix(h))])
    n = np.diff(at).astype(np.uint64)
    return np.where(n > 0, tx.mix(total[at[1:]] - total[at[:-1]] + n * np.uint64(0x9E3779B97F4A7C15)), np.uint64(0))


class Bands:
    """What the bands ask for, given the threshold num / den."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.maximum(np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1, 0)

    def ranges(self, band: np.ndarray) -> np.ndarray:
        """Ranges of the domain in a band; small sets have each shingle for itself."""
        return np.where(band < 4, 1 << 31, np.maximum((1 << band) * 5 // 3, 1))

    def ham(self, n: np.ndarray) -> np.ndarray:
        return n * (self.den - self.num) // self.num

    def spare(self, band: np.ndarray) -> np.ndarray:
        """x: common signatures that a set may leave out."""
        return (1 << band) // 6 + 1

    def below(self, n: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Whether a partner may be in the band below."""
        return (band > 0) & (n * self.num <= ((1 << band) - 1) * self.den)

    def signatures(self, h: np.ndarray, at: np.ndarray, band: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(signature, set) of the sets in use for the given bands, and how many each set has."""
        n = np.diff(at)
        doc = np.repeat(np.arange(len(n)), n)
        pick = use[doc]
        h, doc = h[pick], doc[pick]
        if not len(h):
            return np.zeros(0, np.uint64), doc, np.zeros(len(n), np.int64)
        slot = ((h >> np.uint64(32)) * self.ranges(band)[doc].astype(np.uint64)) >> np.uint64(32)
        new = np.ones(len(h), bool)
        new[1:] = (slot[1:] != slot[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        sig = tx.mix(np.add.reduceat(tx.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first) + (slot[first] << np.uint64(7)))
        doc = doc[first]
        sig = (sig & ~np.uint64(63)) | band[doc].astype(np.uint64)
        order = np.lexsort((sig, doc))
        sig, doc = sig[order], doc[order]
        begin = np.searchsorted(doc, np.arange(len(n) + 1))
        has = np.diff(begin)
        keep = np.where(use, np.minimum(has, self.ham(n) + 1 + self.spare(band)), 0)
        stay = np.arange(len(doc)) - begin[doc] < keep[doc]
        return sig[stay], doc[stay], keep


def _signed(bands: Bands, width: int, batch: pa.RecordBatch) -> Iterator[tuple]:
    """(sizes, names, [(signature, document, kept) for the own band and the one below]) block by block."""
    data, off = tx.utf8(batch.column("text"))
    for _, _, d, o in tx.blocks(data, off):
        doc, _, _, w = tx.words(d, o)
        h, at = sets(*tx.shingles(w, tx.word_counts(doc, len(o) - 1), width))
        n = np.diff(at)
        band = bands.of(n)
        below = bands.below(n, band) & (n > 0)
        yield n, names(h, at), [bands.signatures(h, at, b, use) for b, use in ((band, n > 0), (np.maximum(band - 1, 0), below))]


def _describe(bands: Bands, width: int):
    """A row for each row of docs: its set's size and name, and how many signatures it has in its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(n, name, own[2], low[2]) for n, name, (own, low) in _signed(bands, width, batch)]
            n, name, keep, low = (np.concatenate([x[k] for x in got]) if got else np.zeros(0, np.int64) for k in range(4))
            cols = [pa.array(n.astype(np.int32)), pa.array(name.view(np.int64)), pa.array(keep.astype(np.int32)), pa.array(low.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "k1", "k2")), *cols], ["doc_id", "k1", "k2", "n", "sid", "keep", "keep_low"])

    return run


def _send(bands: Bands, width: int, buckets: int):
    """Signatures in a blob for each bucket and band: 5 bytes of hash each and the place of the set in the blob's own list.

    Within a bucket and band 40 bits tell signatures apart; two that collide only make a pair that is compared in vain.
    """

    def blobs(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        sig, sid, size, slack = (np.concatenate([x[k] for x in held]) for k in range(4))
        bucket = (((sig >> np.uint64(6)) & np.uint64(0x3FFFF)) % np.uint64(buckets)).astype(np.int64) << 6 | (sig & np.uint64(63)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sig, sid, size, slack, bucket = sig[order] >> np.uint64(24), sid[order], size[order], slack[order], bucket[order]
        begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        out: dict[str, list] = {c: [] for c in ("bucket", "band", "sigs", "at", "sids", "sizes", "slacks")}
        for lo, hi in zip(begin, [*begin[1:], len(sig)], strict=True):
            own, first, at = np.unique(sid[lo:hi], return_index=True, return_inverse=True)
            out["bucket"].append(int(bucket[lo] >> 6))
            out["band"].append(int(bucket[lo] & 63))
            out["sigs"].append(sig[lo:hi].view(np.uint8).reshape(-1, 8)[:, :5].tobytes())
            out["at"].append(at.astype(np.uint16 if len(own) <= 1 << 16 else np.uint32).tobytes())
            out["sids"].append(own.tobytes())
            out["sizes"].append(size[lo:hi][first].astype(np.int32).tobytes())
            out["slacks"].append(slack[lo:hi][first].astype(np.int32).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(out[c], pa.int32() if c in ("bucket", "band") else pa.binary()) for c in out], list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        n_held = 0
        sent = np.zeros(0, np.uint64)  # names of the task's sets so far
        for batch in batches:
            for n, name, both in _signed(bands, width, batch):
                new = np.zeros(len(name), bool)
                new[np.unique(name, return_index=True)[1]] = True
                new &= ~np.isin(name, sent)
                sent = np.concatenate([sent, name[new]])
                for sig, own, keep in both:
                    sig, own = sig[new[own]], own[new[own]]
                    held.append((sig, name[own], n[own], (keep - bands.ham(n))[own]))
                    n_held += len(sig)
                if n_held > FLUSH:
                    yield blobs(held)
                    held, n_held = [], 0
        if n_held:
            yield blobs(held)

    return run


def _open(raw: list[bytes]) -> tuple[np.ndarray, ...]:
    """A blob's signatures, and names, sizes and slacks of their sets."""
    n = len(raw[0]) // 5
    sig = np.zeros((n, 8), np.uint8)
    sig[:, :5] = np.frombuffer(raw[0], np.uint8).reshape(n, 5)
    at = np.frombuffer(raw[1], np.uint16 if len(raw[1]) == 2 * n else np.uint32)
    return sig.view(np.uint64)[:, 0], np.frombuffer(raw[2], np.uint64)[at], np.frombuffer(raw[3], np.int32)[at], np.frombuffer(raw[4], np.int32)[at]


def _together(blobs: list) -> list:
    """The same sets and signatures as one blob, copies dropped."""
    sig, sid, size, slack = (np.concatenate([x[k] for x in blobs]) for k in range(4))
    order = np.lexsort((sid, sig))
    new = np.ones(len(order), bool)
    new[1:] = (sig[order][1:] != sig[order][:-1]) | (sid[order][1:] != sid[order][:-1])
    order = order[new]
    return [(sig[order], sid[order], size[order], slack[order])]


def _meet(bands: Bands, few_at_most: int):
    """Pairs of the sets that share uncommon signatures of a bucket and how many; (signature, set) of common ones."""

    def one(now: tuple[int, int], blobs: list) -> Iterator[pa.RecordBatch]:
        sig, sid, size, slack = (np.concatenate([x[k] for x in blobs]) for k in range(4))
        order = np.argsort(sig, kind="stable")
        s = sig[order]
        same = np.zeros(len(s), bool)  # only signatures with two rows or more
        same[1:] = s[1:] == s[:-1]
        same[:-1] |= s[1:] == s[:-1]
        order = order[same]
        order = order[np.lexsort((sid[order], sig[order]))]
        sig, sid, size, slack = sig[order], sid[order], size[order], slack[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])
        sig, sid, size, slack = sig[new], sid[new], size[new], slack[new]
        if not len(sig):
            return
        begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        m = np.diff(np.append(begin, len(sig)))
        m = np.repeat(m, m)
        hot = m > few_at_most
        name = (sig[hot] << np.uint64(20) | np.uint64(now[0] << 6 | now[1])).view(np.int64)
        for k in range(0, len(name), 100_000):
            part = slice(k, k + 100_000)
            yield _pair_rows(name[part], np.ascontiguousarray(sid[hot][part]).view(np.int64), m[hot][part], now[1], 0, True)
        few = (m > 1) & ~hot
        sig, sid, size, slack = sig[few], sid[few], size[few].astype(np.int64), slack[few]
        found = []
        for d in range(1, min(few_at_most, len(sig))):
            near = (sig[d:] == sig[:-d]) & (np.minimum(size[d:], size[:-d]) * bands.den >= np.maximum(size[d:], size[:-d]) * bands.num)
            if (at := np.flatnonzero(near)).size:
                found.append((sid[at], sid[at + d], np.minimum(slack[at], slack[at + d])))
        if found:
            a, b, need = (np.concatenate([x[k] for x in found]) for k in range(3))
            order = np.lexsort((b, a))
            a, b, need = a[order], b[order], need[order]
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            shared = np.diff(np.append(first, len(a)))
            yield _pair_rows(a[first].view(np.int64), b[first].view(np.int64), shared, now[1], need[first], False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        n_held, limit = 0, FLUSH
        for batch in batches:
            for bucket, band, *raw in zip(*(batch.column(c).to_pylist() for c in ("bucket", "band", "sigs", "at", "sids", "sizes", "slacks")), strict=True):
                if (bucket, band) != now and held:
                    yield from one(now, held)
                    held, n_held, limit = [], 0, FLUSH
                now = bucket, band
                held.append(_open(raw))
                n_held += len(held[-1][0])
                if n_held > limit:
                    held = _together(held)
                    n_held = len(held[0][0])
                    limit = max(FLUSH, 2 * n_held)
        if held:
            yield from one(now, held)

    return run


def _pair_rows(a: np.ndarray, b: np.ndarray, m: np.ndarray, band: int, need, hot: bool) -> pa.RecordBatch:
    full = lambda x: np.broadcast_to(np.asarray(x), len(a))
    return pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b), "m": pa.array(m.astype(np.int64)), "band": pa.array(full(band).astype(np.int32)), "need": pa.array(full(need).astype(np.int32)), "hot": pa.array(full(hot))})


def _shingled(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tx.utf8(batch.column("text"))
            out = []
            for _, _, d, o in tx.blocks(data, off):
                doc, _, _, w = tx.words(d, o)
                h, at = sets(*tx.shingles(w, tx.word_counts(doc, len(o) - 1), width))
                out += [h[at[k] : at[k + 1]].tobytes() for k in range(len(o) - 1)]
            yield pa.RecordBatch.from_pydict({"sid": batch.column("sid"), "grams": pa.array(out, pa.binary())})

    return run


def _compare(key: tuple, one: pa.Table, others: pa.Table) -> pa.Table:
    a = np.frombuffer(one["grams"][0].as_py(), np.uint64) if len(one) else np.zeros(0, np.uint64)
    both = []
    for raw in others["held"]:
        b = np.frombuffer(raw.as_buffer(), np.uint64)
        at = np.minimum(np.searchsorted(a, b), max(len(a) - 1, 0))
        both.append(int((a[at] == b).sum()) if len(a) else 0)
    n = [len(x.as_buffer()) // 8 for x in others["held"]]
    return pa.table({"a": others["a"], "b": others["b"], "both": pa.array(both, pa.int64()), "either": pa.array([len(a) + k - c for k, c in zip(n, both, strict=True)], pa.int64())})


def _confront(num: int, den: int):
    """Links between the sets of two blocks of a family that are in different components, by whole incidence counts."""

    def run(key: tuple, own: pa.Table, all_: pa.Table) -> pa.Table:
        a, b = [], []
        if len(own) and len(all_):
            sets_ = [[np.frombuffer(x.as_buffer(), np.uint64) for x in t["grams"]] for t in (own, all_)]
            flat = [np.concatenate(x) for x in sets_]
            both = np.intersect1d(*flat)
            size = [np.array([len(x) for x in y]) for y in sets_]
            at = [np.searchsorted(both, x) for x in flat]
            has = [np.append(both, np.uint64(0))[k] == x for k, x in zip(at, flat, strict=True)]
            has = [h & (k < len(both)) for h, k in zip(has, at, strict=True)]
            row = [np.repeat(np.arange(len(n)), n) for n in size]
            shared = np.zeros((len(size[0]), len(size[1])), np.int64)
            for lo in range(0, len(both), COLUMNS):  # shared shingles at once
                grid = []
                for k, h, r, n in zip(at, has, row, size, strict=True):
                    here = h & (k >= lo) & (k < lo + COLUMNS)
                    m = np.zeros((len(n), min(COLUMNS, len(both) - lo)), np.float32)
                    m[r[here], k[here] - lo] = 1
                    grid.append(m)
                shared += (grid[0] @ grid[1].T).astype(np.int64)
            link = shared * den >= (size[0][:, None] + size[1][None, :] - shared) * num
            link &= own["component"].to_numpy()[:, None] != all_["component"].to_numpy()[None, :]
            i, j = np.nonzero(link)
            a, b = own["sid"].to_numpy()[i], all_["sid"].to_numpy()[j]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _heavy(pairs: DataFrame) -> DataFrame:
    """(sid, blocks) of the sets with over BLOCK pairs."""
    ends = pairs.select(F.col("a").alias("sid")).unionAll(pairs.select(F.col("b").alias("sid")))
    return ends.groupBy("sid").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")


def _dealt(pairs: DataFrame, heavy: DataFrame) -> DataFrame:
    """(a, b, block): the pairs with the set of more pairs first, its partners dealt to blocks of about BLOCK, so that no task holds a family."""
    for c in ("a", "b"):
        pairs = pairs.join(heavy.select(F.col("sid").alias(c), F.col("blocks").alias(f"blocks_{c}")), c, "left")
    pairs = pairs.select("a", "b", *(F.coalesce(f"blocks_{c}", F.lit(1)).alias(f"blocks_{c}") for c in ("a", "b")))
    pick = lambda x, y: F.when(F.col("blocks_b") > F.col("blocks_a"), F.col(y)).otherwise(F.col(x))
    turned = pairs.select(pick("a", "b").alias("a"), pick("b", "a").alias("b"), F.greatest("blocks_a", "blocks_b").alias("blocks"))
    return turned.select("a", "b", F.pmod(F.xxhash64("b"), "blocks").cast("int").alias("block"))


class Join:
    """One run of the join over docs (doc_id, text)."""

    def __init__(self, docs: DataFrame, num: int = 3, den: int = 4, width: int = 5, few: int = FEW) -> None:
        self.bands, self.width = Bands(num, den), width
        k1, k2 = text_key()
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", k1.alias("k1"), k2.alias("k2"))
        buckets = min(parts(docs.sparkSession, 8), 1 << 14)
        self.rows = cut(self.docs.mapInArrow(_describe(self.bands, width), _ROWS))
        blobs = self.docs.select("text").mapInArrow(_send(self.bands, width, buckets), _BLOBS)
        met = cut(blobs.repartition(buckets, "bucket").sortWithinPartitions("bucket", "band").mapInArrow(_meet(self.bands, few), "a long, b long, m long, band int, need int, hot boolean"))
        hot = met.where("hot").select(F.col("a").alias("sig"), F.col("b").alias("sid"), "m", "band")
        common = hot.groupBy("sid", "band").agg(F.count("*").alias("freq"))
        needed = self._needed(hot, common)
        hubs = needed.groupBy("sig").agg(F.max_by("sid", F.struct("freq", "sid")).alias("hub"))
        near = cut(needed.join(hubs, "sig").where("sid <> hub").select(F.least("sid", "hub").alias("a"), F.greatest("sid", "hub").alias("b")).distinct())
        pairs = cut(self._pairs(met.where("NOT hot"), common).unionAll(near).distinct())
        members = needed.select("sid").distinct()
        self.grams = self._grams(pairs.select(F.col("a").alias("sid")).unionAll(pairs.select(F.col("b").alias("sid"))).unionAll(members).distinct())
        links = cut(self._measure(pairs))
        self.components = components(links)
        more = self._rest(members, near)
        if more is not None:
            self.components = components(links.unionAll(more))

    def _pairs(self, few: DataFrame, common: DataFrame) -> DataFrame:
        """Pairs that share as many signatures as links of their sizes must: uncommon ones, and common ones at most as many as each set has."""
        pairs = few.groupBy("a", "b", "band").agg(F.sum("m").alias("shared"), F.max("need").alias("need"))
        for c in ("a", "b"):
            pairs = pairs.join(common.select(F.col("sid").alias(c), "band", F.col("freq").alias(f"hot_{c}")), [c, "band"], "left")
        hot = F.least(F.coalesce("hot_a", F.lit(0)), F.coalesce("hot_b", F.lit(0)))
        return pairs.where(F.col("shared") + hot >= F.col("need")).select("a", "b")

    def _needed(self, hot: DataFrame, common: DataFrame) -> DataFrame:
        """(sig, sid, freq, n) that sets with too few uncommon signatures still need."""
        b = self.bands
        sizes = self.rows.where("n > 0").groupBy("sid").agg(*(F.max(c).alias(c) for c in ("n", "keep", "keep_low")))
        own = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
        deficit = common.join(sizes, "sid").withColumn("deficit", F.floor(F.col("n") * (b.den - b.num) / b.num) + 1 - (F.when(F.col("band") == own, F.col("keep")).otherwise(F.col("keep_low")) - F.col("freq")))
        deficit = deficit.where("deficit > 0").select("sid", "band", "deficit", "freq", "n")
        rank = F.row_number().over(Window.partitionBy("sid", "band").orderBy("m", "sig"))
        return cut(hot.join(deficit, ["sid", "band"]).withColumn("rank", rank).where("rank <= deficit").select("sig", "sid", "freq", "n"))

    def _grams(self, need: DataFrame) -> DataFrame:
        """(sid, grams): the shingle hashes of the sets asked for, read from one text of each."""
        source = self.rows.join(need, "sid").groupBy("sid").agg(F.min(F.struct("k1", "k2", "doc_id")).alias("x")).select("sid", "x.*")
        docs = self.docs.withColumnRenamed("doc_id", "own")
        texts = docs.join(source, (docs.k1 == source.k1) & (docs.k2 == source.k2) & docs.own.eqNullSafe(source.doc_id)).select("sid", "text")
        return cut(texts.mapInArrow(_shingled(self.width), "sid long, grams binary"))

    def _measure(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose whole sets are similar enough."""
        heavy = cut(_heavy(pairs))
        sent = _dealt(pairs, heavy).join(self.grams.select(F.col("sid").alias("b"), F.col("grams").alias("held")), "b").select("a", "b", "block", "held")
        own = self.grams.join(heavy, "sid", "left").select("sid", "grams", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block"))
        got = own.groupBy("sid", "block").cogroup(sent.groupBy("a", "block")).applyInArrow(_compare, "a long, b long, both long, either long")
        return got.where(F.col("both") * self.bands.den >= F.col("either") * self.bands.num).select("a", "b")

    def _rest(self, members: DataFrame, near: DataFrame) -> DataFrame | None:
        """Links of sets with common signatures that the hubs left in another component than their family's largest."""
        part = lambda df, name: df.select(F.col("id").alias("sid"), F.col("component").alias(name))
        c = members.join(part(self.components, "component"), "sid", "left").join(part(components(near), "family"), "sid", "left")
        c = cut(c.select("sid", F.coalesce("component", "sid").alias("component"), F.coalesce("family", "sid").alias("family")))
        home = c.groupBy("family", "component").agg(F.count("*").alias("k")).groupBy("family").agg(F.max_by("component", F.struct("k", "component")).alias("home"), F.sum("k").alias("all"), F.max("k").alias("most"))
        home = home.where("all > most").select("family", "home", F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("own_blocks"))
        c = c.join(home, "family").join(self.grams.dropDuplicates(["sid"]), "sid")
        c = cut(c.select("*", (F.col("component") != F.col("home")).alias("apart")))
        if c.where("apart").isEmpty():
            return None
        deal = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), F.col("sid")), F.col(n)).cast("int")
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = c.where("apart").select("family", "sid", "component", "grams", deal(1, "own_blocks").alias("own"), spread("blocks").alias("block"))
        every = c.select("family", "sid", "component", "grams", deal(2, "blocks").alias("block"), spread("own_blocks").alias("own"))
        keys = ("family", "own", "block")
        return cut(own.groupBy(*keys).cogroup(every.groupBy(*keys)).applyInArrow(_confront(self.bands.num, self.bands.den), "a long, b long"))

    def classes(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every row, by the smallest doc_id of the component."""
        rows = self._grouped()
        least = rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
        rows = rows.join(least, "class", "left")
        return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))

    def copies(self) -> DataFrame:
        """(doc_id, k1, k2) of every id and text (by its key) but one of each group: the smallest id stays, null ids last."""
        rows = self._grouped("k1", "k2").where("n > 0").select("class", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2").alias("x")).distinct()
        first = rows.groupBy("class").agg(F.min("x").alias("first"))
        return rows.join(first, "class").where("NOT x <=> first").select("x.doc_id", "x.k1", "x.k2")

    def _grouped(self, *more: str) -> DataFrame:
        rows = self.rows.select("doc_id", "n", "sid", *more).join(self.components.select(F.col("id").alias("sid"), "component"), "sid", "left")
        return rows.withColumn("class", F.coalesce("component", "sid"))


def classes(docs: DataFrame, num: int = 3, den: int = 4, width: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles and component_id. See the module's notes."""
    return Join(docs, num, den, width).classes()


def copies(docs: DataFrame, num: int = 3, den: int = 4, width: int = 5) -> DataFrame:
    """The ids and text keys (doc_id, k1, k2 of ``text_key``) of all but one of each linked group."""
    return Join(docs, num, den, width).copies()
