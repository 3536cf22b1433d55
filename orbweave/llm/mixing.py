"""Language-model scoring: online logistic mixing of bit predictors, one for each hashed context.

A text is its bytes and an end mark. A byte is a walk down a binary code that depends on the
byte before it (built from how often bytes follow one another in the corpus, so that frequent
bytes take few steps), which makes a text a row of binary decisions. Each context, ORDERS
bytes before the byte and the letters of the word so far, predicts every decision from how often both
answers followed it in the training texts of the corpus. A logistic mixer combines the
stretched predictions with weights that a gate picks (which of the long contexts the
corpus knows) and that are refined along the text: after every decision the gradient of its
coding cost moves the text's own weights. Weights begin alike in every text, and anew after
STRETCH bytes of it, so that a long text is many rows of numpy's arrays and not one loop. The
sum of costs is the text's log probability: over all texts of any length they add up to one.

What is learned grows with the corpus and none of it is broadcast but the code (256 trees).
Input tasks part their documents into flocks of about FLOCK bytes. A flock sends its distinct
words, and its distinct pairs of a context (a 44-bit hash) and a byte, with their counts in
training texts, to buckets by hash; a bucket adds them up and answers each flock's words with
counts and each flock's pairs with the prediction at every node of the byte's walk, in SCALE
steps. The answers meet the flock's texts again. Buckets grow in number with the corpus, so
no task holds more of the model than its share.

Defined cases: null text counts as empty; an empty text is its end mark; words and contexts
longer than WORD bytes begin anew after them; repeated rows are documents each; a null doc_id
is in training (its remainder is taken as 1); with no training documents counts are 0 and the
base score is null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm import _text as tx
from orbweave.llm._io import discard, parts, release, written

ORDERS = (2, 3, 5)  # and the word so far
INPUTS = len(ORDERS) + 1
FLOCK = 10 << 20
BUCKET = 16 << 20  # bytes of the corpus for each bucket
STRETCH = 1024
WORD = 64  # bytes of a word that a context holds
BATCH = 3 << 20  # bytes of the stretches that move on together
PART = 1 << 16  # bytes of a batch whose predictions are looked up together
TOGETHER = 16  # stretches whose decisions are put in their places together
HELD = 500_000  # pairs that a flock holds before it counts them
RATE = 0.006
START = 0.3
SCALE = 8 / 127
END = 0xFF  # no byte of UTF-8
REACH = max(ORDERS)


class Code:
    """For every byte before, a tree over the 256 bytes by halving their counts, the frequent ones first.

    A leaf is a number below 65536: the byte before, and the byte's place in its tree; the
    leaves below a node of a walk are those from ``below`` to ``above``.
    """

    def __init__(self, follows: np.ndarray) -> None:
        c = follows.reshape(256, 256) + 2.0**-10
        c += c.sum(1, keepdims=True) / 2**16
        order = np.argsort(-c, axis=1, kind="stable")
        total = np.concatenate([[0.0], np.cumsum(np.take_along_axis(c, order, 1))])
        me = np.arange(65536)
        lo = me & ~255
        hi = lo + 256
        below, above, self.steps = [lo], [hi], np.zeros(65536, np.int64)
        while len(open_ := np.flatnonzero(hi - lo > 1)):
            lo, hi = lo.copy(), hi.copy()
            a, b = lo[open_], hi[open_]
            middle = (total[a] + total[b]) / 2
            s = np.searchsorted(total, middle)
            s -= middle - total[s - 1] < total[s] - middle
            s = np.clip(s, a + 1, b - 1)
            right = me[open_] >= s
            lo[open_], hi[open_] = np.where(right, s, a), np.where(right, b, s)
            self.steps[open_] += 1
            below.append(lo)
            above.append(hi)
        self.below, self.above = np.array(below, np.uint64), np.array(above, np.uint64)
        self.leaf = np.zeros(65536, np.int64)
        self.leaf[(me & ~255) + order.reshape(-1)] = me
        #: Steps of the walk to a byte after another, both as one number.
        self.walk = self.steps[self.leaf]


def stream(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The bytes of documents, an end mark after each."""
    end, edges = np.array([END], np.uint8), off.tolist()
    return np.concatenate([np.zeros(0, np.uint8), *(x for a, b in zip(edges, edges[1:]) for x in (data[a:b], end))])


class Contexts:
    """Contexts along a stream, block by block: each byte with the REACH bytes before it, pairs of words of REACH letters or more, and words' hashes."""

    def __init__(self) -> None:
        self.tail = np.full(REACH, END, np.uint8)
        self.word = np.zeros(0, np.uint8)  # the bytes of the word that the last block left open

    def __call__(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(last bytes with the byte itself lowest, places of bytes after long words so far, their pairs, places of words' ends, words' hashes) of the block."""
        n = len(block)
        near = np.concatenate([self.tail, block])
        wide = near.astype(np.uint64)
        last = wide[REACH:].copy()
        for k in range(1, REACH + 1):
            last |= wide[REACH - k : REACH - k + n] << np.uint64(8 * k)
        ends = np.flatnonzero(near == END)
        for k in range(1, REACH):  # what lies before an end mark is another document
            at = ends + k - REACH
            at = at[(at >= 0) & (at < n)]
            last[at] |= np.uint64((1 << 8 * (REACH + 1)) - (1 << 8 * (k + 1)))
        own, known = np.concatenate([self.word, block]), len(self.word)
        gap = tx.SPACE[own] | (own == END)
        places = np.arange(len(own))
        begin = np.zeros(len(own), np.int64)
        np.maximum.accumulate(np.where(gap, places + 1, 0)[:-1], out=begin[1:])
        total = np.zeros(len(own) + 1, np.uint64)
        np.cumsum((tx.LOWER[own].astype(np.uint64) + np.uint64(1)) * tx._power("up", len(own))[: len(own)], out=total[1:])
        down = tx._power("down", len(own) + 1)
        since = places - begin
        ended = np.flatnonzero(gap & (since > 0))
        words = tx.mix((total[ended] - total[begin[ended]]) * down[begin[ended]])
        at = np.flatnonzero(since >= REACH)
        at = at[np.searchsorted(at, known) :]
        lo = begin[at]
        if (far := since[at] >= WORD).any():
            lo[far] += since[at][far] // WORD * WORD
        pairs = _hashed((total[at] - total[lo]) * down[lo], 0) | (last[at - known] & np.uint64(0xFFFF))
        self.tail = near[-REACH:]
        self.word = own[begin[-1] if not gap[-1] else len(own) :]
        return last, at - known, pairs, ended - known, words


def _hashed(h: np.ndarray, kind: int) -> np.ndarray:
    """44 bits of a context's hash, above 16 bits for a byte and the one before."""
    h = (h + np.uint64(kind * 0x9E37 + 1)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) >> np.uint64(20) << np.uint64(16)


def _order(last: np.ndarray, k: int) -> np.ndarray:
    return last & np.uint64((1 << 8 * (k + 1)) - 1)


def _order_pairs(last: np.ndarray, k: int) -> np.ndarray:
    return _hashed(_order(last, k) >> np.uint64(8), k) | (last & np.uint64(0xFFFF))


def _short_words(last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which last bytes follow a word so far of fewer than REACH letters, and the pairs of that word and the byte."""
    held, short = np.zeros(len(last), np.uint64), np.zeros(len(last), bool)
    for k in range(1, REACH + 1):
        b = (last >> np.uint64(8 * k) & np.uint64(0xFF)).astype(np.uint8)
        short |= tx.SPACE[b] | (b == END)
        held |= np.where(short, np.uint64(0), tx.LOWER[b].astype(np.uint64) << np.uint64(8 * k))
    at = np.flatnonzero(short)
    return at, _hashed(held[at] >> np.uint64(8), 1) | (last[at] & np.uint64(0xFFFF))


def _runs(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


class Counter:
    """Distinct numbers below 2^63, and how many of them were marked."""

    def __init__(self) -> None:
        self.held: list[np.ndarray] = []
        self.n = 0
        self.keys, self.counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]

    def add(self, x: np.ndarray, marked: np.ndarray) -> None:
        self.held.append(x << np.uint64(1) | marked)
        self.n += len(x)
        if self.n >= HELD:
            self._count()

    def _count(self) -> None:
        x = np.concatenate(self.held)
        x.sort()
        first = _runs(x >> np.uint64(1))
        self.keys.append(x[first] >> np.uint64(1))
        self.counts.append(np.add.reduceat((x & np.uint64(1)).astype(np.int32), first))
        self.held, self.n = [], 0
        if sum(map(len, self.keys)) > max(2 * HELD, 3 * len(self.keys[0]) // 2):
            self._merge()

    def _merge(self) -> None:
        x, c = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(x, kind="stable")
        x, c = x[order], c[order]
        first = _runs(x)
        self.keys, self.counts = [x[first]], [np.add.reduceat(c, first)]

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        if self.n:
            self._count()
        if len(self.keys) > 1:
            self._merge()
        return self.keys[0], self.counts[0]


class Distinct(Counter):
    """Distinct numbers below 2^63 without counts."""

    def add(self, x: np.ndarray, marked: np.ndarray | None = None) -> None:
        self.held.append(x)
        self.n += len(x)
        if self.n >= HELD:
            self._count()

    def _count(self) -> None:
        x = np.concatenate(self.held)
        x.sort()
        self.keys.append(x[_runs(x)])
        self.held, self.n = [], 0
        if sum(map(len, self.keys)) > max(4 * HELD, 3 * len(self.keys[0]) // 2):
            self._merge()

    def _merge(self) -> None:
        x = np.concatenate(self.keys)
        x.sort()
        self.keys = [x[_runs(x)]]


class Asked:
    """A flock's distinct pairs, in order, from its distinct last bytes and pairs of long words; ``at``: of each distinct value of each input where its pair lies."""

    def __init__(self, last: np.ndarray, long_words: np.ndarray) -> None:
        self.short, words = _short_words(last)
        held, own = [], []
        for x in chain((_order_pairs(last, k) for k in ORDERS), (words, long_words)):  # each for itself first, so that no array is as long as all
            distinct, at = np.unique(x, return_inverse=True)
            held.append(distinct)
            own.append(at.astype(np.int32))
        self.pairs, at = np.unique(np.concatenate(held), return_inverse=True)
        at = at.astype(np.int32)
        self.at = [part[x] for part, x in zip(np.split(at, np.cumsum([len(x) for x in held])[:-1]), own, strict=True)]

    def sums(self, n_last: np.ndarray, n_long: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.pairs), np.int64)
        for where, n in zip(self.at, (*[n_last] * len(ORDERS), n_last[self.short], n_long), strict=True):
            out += np.bincount(where, n, len(out)).astype(np.int64)
        return out


def predictions(code: Code, pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of all pairs of some contexts (distinct, in any order): ln of the odds of the byte's own answer at each step of its walk, in SCALE steps, and where they begin."""
    leaf = code.leaf[(pairs & np.uint64(0xFFFF)).astype(np.int64)]
    key = pairs >> np.uint64(16) << np.uint64(16) | leaf.astype(np.uint64)
    order = np.argsort(key)
    sorted_ = key[order]
    total = np.concatenate([[0], np.cumsum(counts[order])])
    base = key >> np.uint64(16) << np.uint64(16)
    steps = code.steps[leaf]
    at = np.cumsum(steps) - steps
    out = np.zeros(int(steps.sum()), np.int8)
    edge = lambda which, leaves: np.searchsorted(sorted_, base[which] + leaves)
    for lo in range(0, len(order), PART * 4):
        which = order[lo : lo + PART * 4]
        which = which[steps[which] > 0]
        below = code.below[0, leaf[which]]
        low, high, j = edge(which, below), edge(which, code.above[0, leaf[which]]), 0
        all_ = total[high] - total[low]
        while len(which):  # a step moves one end of the leaves below, the other stays
            before, below = below, code.below[j + 1, leaf[which]]
            right = below != before
            middle = edge(which, np.where(right, below, code.above[j + 1, leaf[which]]))
            low, high = np.where(right, middle, low), np.where(right, high, middle)
            own = total[high] - total[low]
            out[at[which] + j] = np.rint(np.clip(np.log((own + 0.05) / (all_ - own + 0.05)), -8, 8) / SCALE)
            j += 1
            more = steps[which] > j
            which, all_, below, low, high = (x[more] for x in (which, own, below, low, high))
    return out, at


class Table:
    """The place of a number among distinct ones: a directory of leading bits leads to the other bits and the place as one number."""

    def __init__(self, keys: np.ndarray) -> None:
        n = max(len(keys), 1)
        bits = max(8, n.bit_length() + 1)
        self.shift, self.up, self.low = np.uint64(64 - bits), np.uint64(bits), np.uint64(n.bit_length())
        mixed = self._mixed(keys)
        order = np.argsort(mixed)
        self.held = mixed[order] << self.up >> self.low << self.low | order.astype(np.uint64)
        self.start = np.minimum(np.searchsorted(mixed[order], np.arange(1 << bits, dtype=np.uint64) << self.shift), n - 1).astype(np.int32)
        self.mask = np.uint64((1 << n.bit_length()) - 1)

    @staticmethod
    def _mixed(keys: np.ndarray) -> np.ndarray:
        return keys * np.uint64(0x9E3779B97F4A7C15)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        mixed = self._mixed(keys)
        at = self.start[mixed >> self.shift]
        mixed <<= self.up
        got = self.held[at]
        miss = np.flatnonzero((got ^ mixed) > self.mask)
        while len(miss):
            at[miss] += 1
            got[miss] = again = self.held[at[miss]]
            miss = miss[(again ^ mixed[miss]) > self.mask]
        return (got & self.mask).astype(np.int64)


def stretches(off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the stretches of documents begin in their stream, and the documents they belong to."""
    size = np.diff(off) + 1
    n = -(-size // STRETCH)
    doc = np.repeat(np.arange(len(size)), n)
    return (np.cumsum(size) - size)[doc] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRETCH, doc


def _costs(known: np.ndarray, begin: list[np.ndarray], steps: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The cost in nats of each stretch of a batch; all move on by a decision at once, each with weights of its own.

    begin: for each input where each byte's predictions begin in ``known``; steps: of each byte's walk; start: of each stretch.
    """
    at = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
    lo = at[start]
    size = np.diff(np.append(lo, at[-1]))
    by = np.argsort(-size, kind="stable")
    n, most = len(size), size[by[0]]
    active = n - np.cumsum(np.bincount(size, minlength=most + 1))[:most]  # stretches with a decision at each step
    edges = np.concatenate([[0], np.cumsum(active)])
    # All first decisions come before all second ones. Stretches of like length are put there together: what they write lies side by side.
    rows, gate = np.empty((at[-1], INPUTS), np.int8), np.empty(at[-1], np.int8)
    item, length = rows.view(np.int32).reshape(-1), np.diff(np.append(start, len(steps)))
    for low in range(0, n, TOGETHER):
        these = by[low : low + TOGETHER]
        many, total = length[these], size[these]
        if not total.any():
            break
        which = np.arange(many.sum()) + np.repeat(start[these] - (np.cumsum(many) - many), many)
        walk = steps[which]
        inside = np.cumsum(walk, dtype=np.int64) - walk
        own, place = np.repeat(np.arange(len(walk)), walk), np.arange(total.sum())
        x = np.empty((len(place), INPUTS), np.int8)
        for k, b in enumerate(begin):
            of = (b[which] - inside).take(own, mode="clip")
            of += place
            x[:, k] = known.take(of, mode="clip")
        first = np.minimum(inside, len(x) - 1)
        place -= np.repeat(np.cumsum(total) - total, total)
        to = edges.take(place, mode="clip")
        to += np.repeat(np.arange(low, low + len(these)), total)
        item[to] = x.view(np.int32).reshape(-1)
        gate[to] = ((x[first, INPUTS - 2] != 0) * 2 + (x[first, INPUTS - 1] != 0)).astype(np.int8).take(own, mode="clip")
    edges = edges.tolist()
    del at, item
    begin.clear()
    four = np.arange(n, dtype=np.int64) * 4
    weights = np.full((4 * n, INPUTS), START * SCALE, np.float32)
    whole = weights.view(np.complex128).reshape(-1)  # a row of weights as one item
    z = np.empty(len(rows), np.float32)
    rate, one = np.float32(RATE * SCALE * SCALE), np.ones(INPUTS, np.float32)
    buffer = np.empty((n, INPUTS), np.float32)
    with np.errstate(over="ignore"):
        for low in range(0, len(edges) - 1, 32):
            these = edges[low : low + 33]
            given = rows[these[0] : these[-1]].astype(np.float32)
            for s, e in zip(these, these[1:]):
                cell = four[: e - s] + gate[s:e]
                item = whole.take(cell)
                w, v = item.view(np.float32).reshape(-1, INPUTS), given[s - these[0] : e - these[0]]
                got = np.multiply(w, v, out=buffer[: e - s]).dot(one, out=z[s:e])
                pull = np.exp(got)
                pull += 1
                np.divide(rate, pull, out=pull)
                v *= np.dot(pull[:, None], one[None], out=buffer[: e - s])  # rows as long as all: a product by column is a loop for each row
                w += v
                whole[cell] = item
    out = np.zeros(n)
    for low in range(0, len(edges) - 1, 256):
        these = edges[low : low + 257]
        part = z[these[0] : these[-1]]
        held = np.maximum(part, -80)
        cost = np.log(1 + np.exp(-held)) + (held - part)
        part = np.zeros(n)
        for a, b in zip(these, these[1:]):
            part[: b - a] += cost[a - these[0] : b - these[0]]
        out += part
    back = np.empty(n)
    back[by] = out
    return back


class Begin:
    """Where the predictions of bytes begin, by their last bytes and long words."""

    def __init__(self, asked: Asked, code: Code, last: np.ndarray, long_words: np.ndarray) -> None:
        steps = code.walk[(asked.pairs & np.uint64(0xFFFF)).astype(np.int64)]
        begin = (np.cumsum(steps) - steps).astype(np.int32)
        self.last, self.words = Table(last), Table(long_words)
        of_last = np.zeros((len(last), INPUTS), np.int32)
        for k, x in enumerate(asked.at[:-2]):
            of_last[:, k] = begin[x]
        of_last[asked.short, -1] = begin[asked.at[-2]]
        self.of_last = of_last.view(np.complex128).reshape(-1)  # all inputs of last bytes as one item
        self.of_words = begin[asked.at[-1]]

    def __call__(self, last: np.ndarray, at: np.ndarray, long_words: np.ndarray) -> list[np.ndarray]:
        out = list(self.of_last.take(self.last(last)).view(np.int32).reshape(-1, INPUTS).T)
        if len(at):
            out[-1][at] = self.of_words[self.words(long_words)]
        return out


def costs(known: np.ndarray, begin_of: Begin, code: Code, text: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The cost in nats of each document of a stream, whose offsets without end marks are off."""
    start, doc = stretches(off)
    group = start // BATCH
    out = np.zeros(len(off) - 1)
    see = Contexts()
    for batch in np.split(np.arange(len(start)), np.flatnonzero(np.diff(group)) + 1):
        if not len(batch):
            continue
        lo, hi = start[batch[0]], start[batch[-1] + 1] if batch[-1] + 1 < len(start) else len(text)
        begin = [np.empty(hi - lo, np.int32) for _ in range(INPUTS)]
        steps = np.empty(hi - lo, np.int32)
        for a in range(lo, hi, PART):
            last, at, words, _, _ = see(text[a : min(a + PART, hi)])
            here = slice(a - lo, a - lo + len(last))
            for to, x in zip(begin, begin_of(last, at, words), strict=True):
                to[here] = x
            steps[here] = code.walk[(last & np.uint64(0xFFFF)).astype(np.int64)]
        out += np.bincount(doc[batch], _costs(known, begin, steps, start[batch] - lo), len(out))
    return out


_LEARNED = "kind int, bucket int, flock long, words binary, counts binary, pairs binary, seen binary, docs binary"
TEXTS, ASKS, SUMS = 0, 1, 2
_ANSWERS = "bucket int, flock long, counts binary, known binary, distinct long, tokens long"


def _pack(x: np.ndarray) -> bytes:
    """Numbers as compressed bytes, the like bytes of all together."""
    return np.array([len(x)], np.int64).tobytes() + pa.Codec("zstd", 3).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T), asbytes=True)


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    n, width = int(np.frombuffer(raw[:8], np.int64)[0]), np.dtype(kind).itemsize
    flat = np.frombuffer(pa.decompress(raw[8:], n * width, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, n).T).view(kind).reshape(-1)


def _rising(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=np.uint64(0)))


def _pack_pairs(x: np.ndarray) -> bytes:
    """Pairs in order as four columns: the contexts' steps, the bytes before, how many pairs each has, and their bytes."""
    group = x >> np.uint64(8)
    first = _runs(group)
    cols = [_rising(group[first] >> np.uint64(8)), _pack((group[first] & np.uint64(255)).astype(np.uint8)), _pack(np.diff(np.append(first, len(x))).astype(np.uint16)), _pack((x & np.uint64(255)).astype(np.uint8))]
    return np.array([len(c) for c in cols], np.int64).tobytes() + b"".join(cols)


def _unpack_pairs(raw: bytes) -> np.ndarray:
    at = 32 + np.cumsum(np.append(0, np.frombuffer(raw[:32], np.int64)))
    cols = [_unpack(raw[a:b], t) for a, b, t in zip(at, at[1:], (np.uint64, np.uint8, np.uint16, np.uint8))]
    group = np.cumsum(cols[0]) << np.uint64(8) | cols[1]
    return np.repeat(group, cols[2]) << np.uint64(8) | cols[3]


def _packed_docs(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
        for b in batches:
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


class Gathered:
    """What a stream holds: distinct last bytes, pairs of long words and words, each with its count in training documents (where train is given); and all words by document."""

    def __init__(self, text: np.ndarray, train: np.ndarray | None = None) -> None:
        kind = Distinct if train is None else Counter
        lasts, pairs, words = kind(), kind(), kind()
        see, doc = Contexts(), 0
        if train is not None:
            train = np.append(train, False).astype(np.uint64)
        docs, every = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for lo in range(0, len(text), tx.BLOCK):
            block = text[lo : lo + tx.BLOCK]
            last, at, pair, ended, word = see(block)
            ends = np.flatnonzero(block == END)
            own = np.repeat(np.arange(doc, doc + len(ends) + 1), np.diff(np.concatenate([[-1], ends, [len(block) - 1]])))
            doc += len(ends)
            word >>= np.uint64(1)
            if train is None:
                lasts.add(last)
                pairs.add(pair)
                words.add(word)
            else:
                marked = train[own]
                lasts.add(last, marked)
                pairs.add(pair, marked[at])
                words.add(word, marked[ended])
            docs.append(own[ended])
            every.append(word)
        self.last, self.pairs, self.words = lasts.result(), pairs.result(), words.result()
        self.of_doc, self.every = np.concatenate(docs), np.concatenate(every)


def _learn(buckets: int):
    """Flocks of a task's documents: their texts, and their distinct words and pairs by bucket with training counts."""

    def ask(flock: int, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = {c: [] for c in ("kind", "bucket", "words", "counts", "pairs", "seen", "docs")}

        def row(kind: int, bucket: int = 0, **cols: bytes) -> None:
            for c, x in rows.items():
                x.append({"kind": kind, "bucket": bucket}.get(c, cols.get(c)))

        docs = pa.Table.from_batches(batches)
        row(TEXTS, docs=_packed_docs(batches))
        train = docs["train"].to_numpy()
        found = Gathered(stream(*tx.utf8(docs["text"])), train)
        (last, n_last), (long_words, n_long), (word, n_word) = found.last, found.pairs, found.words
        follows = np.bincount((last & np.uint64(0xFFFF)).astype(np.int64), n_last, 65536).astype(np.int64)
        row(SUMS, counts=_pack(follows), seen=np.array([train.sum()], np.int64).tobytes())
        del found
        release()
        asked = Asked(last, long_words)
        pairs, seen = asked.pairs, asked.sums(n_last, n_long)
        edge = lambda b: np.searchsorted(b, np.arange(buckets + 1, dtype=np.uint64))
        # Buckets are ranges of the hashes, so both are in order of buckets already.
        words_at, pairs_at = edge(_bucket(word, 63, buckets)), edge(_bucket(pairs, 60, buckets))
        for b in range(buckets):
            w, p = slice(words_at[b], words_at[b + 1]), slice(pairs_at[b], pairs_at[b + 1])
            if w.start < w.stop or p.start < p.stop:
                row(ASKS, b, words=_rising(word[w]), counts=_pack(n_word[w].astype(np.int32)), pairs=_pack_pairs(pairs[p]), seen=_pack(seen[p].astype(np.int32)))
        cols = [pa.array(rows["kind"], pa.int32()), pa.array(rows["bucket"], pa.int32()), pa.array(np.full(len(rows["kind"]), flock)), *(pa.array(rows[c], pa.binary()) for c in ("words", "counts", "pairs", "seen", "docs"))]
        del asked, pairs, seen, last, long_words, word
        release()
        yield pa.RecordBatch.from_arrays(cols, ["kind", "bucket", "flock", "words", "counts", "pairs", "seen", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flock, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for k in range(0, len(batch), 1000):
                part = batch.slice(k, 1000)
                own = pa.compute.sum(pa.compute.binary_length(part.column("text"))).as_py() or 0
                if held and size + own > 1.2 * FLOCK:
                    yield from ask(flock, held)
                    flock, held, size = flock + 1, [], 0
                held.append(part)
                size += own
        if held:
            yield from ask(flock, held)

    return run


def _bucket(h: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """By the leading 32 of so many bits."""
    return ((h >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often bytes followed others, and the training documents (place -1), in a task's flocks."""
    total, docs = np.zeros(65536, np.int64), 0
    for batch in batches:
        for x, n in zip(batch.column("counts"), batch.column("seen"), strict=True):
            total += _unpack(x.as_py(), np.int64)
            docs += int(np.frombuffer(n.as_buffer(), np.int64)[0])
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], docs))], ["place", "n"])


def _answer(held):
    """A bucket's counts and predictions for each flock that asked; distinct training words and their occurrences in the bucket."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        code = Code(held.value)
        asked = [np.cumsum(_unpack(x.as_py(), np.uint64)) for x in rows["words"]]
        own = np.concatenate([_unpack(x.as_py(), np.int32) for x in rows["counts"]]).astype(np.int64)
        word, at = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(at, own, len(word)).astype(np.int64)
        pairs = [_unpack_pairs(x.as_py()) for x in rows["pairs"]]
        pair, pair_at = np.unique(np.concatenate(pairs), return_inverse=True)
        seen = np.bincount(pair_at, np.concatenate([_unpack(x.as_py(), np.int32) for x in rows["seen"]]), len(pair)).astype(np.int64)
        odds, odds_at = predictions(code, pair, seen)
        steps = code.walk[(pair & np.uint64(0xFFFF)).astype(np.int64)]
        got, known, begin, pair_begin = [], [], 0, 0
        for x, p in zip(asked, pairs, strict=True):
            got.append(_pack(total[at[begin : begin + len(x)]]))
            begin += len(x)
            of = pair_at[pair_begin : pair_begin + len(p)]
            pair_begin += len(p)
            n = steps[of]
            known.append(_pack(odds[np.repeat(odds_at[of] - (np.cumsum(n) - n), n) + np.arange(n.sum())]))
        n = len(asked)
        first = np.zeros(n, np.int64)
        del pairs, pair_at, odds, odds_at, seen, steps
        release()
        return pa.table({
            "bucket": rows["bucket"], "flock": rows["flock"], "counts": pa.array(got, pa.binary()), "known": pa.array(known, pa.binary()),
            "distinct": pa.array(np.append((total > 0).sum(), first)[:n].astype(np.int64)), "tokens": pa.array(np.append(total.sum(), first)[:n].astype(np.int64)),
        })

    return run


def _scored(held, tokens: int, distinct_words: int, train_docs: int):
    def run(key: tuple, flock: pa.Table, answers: pa.Table) -> pa.Table:
        code = Code(held.value)
        docs = pa.concat_tables(pa.ipc.open_stream(x.as_buffer()).read_all() for x in flock["docs"])
        answers = answers.sort_by("bucket")
        data, off = tx.utf8(docs["text"])
        text = stream(data, off)
        n_docs = len(docs)
        found = Gathered(text)
        last, long_words, word = found.last[0], found.pairs[0], found.words[0]
        count = np.concatenate([_unpack(x.as_py(), np.int64) for x in answers["counts"]])
        below = tokens + 0.1 * (distinct_words + 1)
        n_tokens = 1 + np.bincount(found.of_doc, minlength=n_docs)
        n_known, base = np.full(n_docs, float(train_docs > 0)), np.full(n_docs, np.log10((train_docs + 0.1) / below))
        if len(word):
            c = count[np.searchsorted(word, found.every)]
            n_known += np.bincount(found.of_doc, c > 0, n_docs)
            base += np.bincount(found.of_doc, np.log10((c + 0.1) / below), n_docs)
        del found, data
        release()
        known = np.concatenate([_unpack(x.as_py(), np.int8) for x in answers["known"]])
        cost = costs(known, Begin(Asked(last, long_words), code, last, long_words), code, text, off)
        del known, last, long_words
        release()
        size = np.diff(off)
        none = np.full(n_docs, tokens == 0)
        bits = np.divide(cost, np.log(2) * size, out=np.zeros(n_docs), where=size > 0)
        return pa.table({
            "doc_id": docs["doc_id"], "held_out": pa.compute.invert(docs["train"].combine_chunks()), "n_tokens": pa.array(n_tokens.astype(np.int64)), "n_known": pa.array(n_known.astype(np.int64)),
            "train_tokens": pa.array(np.full(n_docs, tokens)), "base_score": pa.array(base, mask=none), "score": pa.array(-cost / np.log(10)), "bits_per_byte": pa.array(bits, mask=size == 0),
        })

    return run


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability), bits_per_byte."""
    import pyarrow.compute  # noqa: F401

    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    schema = f"doc_id {docs.schema[key].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    train = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 10 != 0, F.lit(True))
    d = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), train.alias("train"))
    tasks = max(1, -(-size // FLOCK))
    given = d.rdd.getNumPartitions()  # a task may part its documents into several flocks; texts are dealt anew only where tasks would be few
    d = d.coalesce(tasks) if given >= tasks else d.repartition(tasks) if given < parts(spark, 8) // 8 else d
    buckets = max(parts(spark, 8), -(-size // BUCKET))
    learned = written(d.mapInArrow(_learn(buckets), _LEARNED), by=("kind",))  # texts and requests in folders of their own
    read = lambda kind: spark.read.schema(_LEARNED).option("basePath", learned).parquet(f"{learned}/kind={kind}")
    if size == 0 and d.isEmpty():
        return spark.createDataFrame([], schema)
    follows = np.zeros(65536, np.int64)
    train_docs = 0
    for r in read(SUMS).select("counts", "seen").mapInArrow(_sums, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():  # at most 65,537 rows
        if r.place < 0:
            train_docs = r.n
        else:
            follows[r.place] = r.n
    held = spark.sparkContext.broadcast(follows)
    asked = read(ASKS).select("bucket", "flock", "words", "counts", "pairs", "seen")
    answered = written(asked.groupBy("bucket").applyInArrow(_answer(held), _ANSWERS))
    discard(spark, f"{learned}/kind={ASKS}")
    answers = spark.read.schema(_ANSWERS).parquet(answered)
    total = answers.agg(F.sum("distinct"), F.sum("tokens")).first()
    texts, back = read(TEXTS).select("flock", "docs"), answers.select("bucket", "flock", "counts", "known")
    tokens, distinct_words = (total[1] or 0) + train_docs, (total[0] or 0) + (train_docs > 0)
    return texts.groupBy("flock").cogroup(back.groupBy("flock")).applyInArrow(_scored(held, tokens, distinct_words, train_docs), schema)
