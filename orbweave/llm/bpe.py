"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside each partition.

Each task gathers the distinct pre-tokens of its texts. Their bytes become
token-position rows; a recursive query joins neighbouring rows to the merge table,
contracts every word's leftmost pair of minimum rank and stops at the fixpoint. A word that
is a vocabulary entry is one finished row from the start, as the tiktoken library takes it.
Rows in order are the ids of every word. Texts are put together from their words' ids by
Arrow's list functions, and decoded by taking from the vocabulary what each id stands for:
all decoded bytes come from ids.

A round of the recursion makes one merge of each word and rewrites its rows, so its work for
one word grows with the square of the length. Words over LONG bytes, which would not end,
are merged in the same order (leftmost pair of minimum rank) by a heap over a linked list;
they decode as all others do.

Work for a text is linear in its words; texts never leave their partition, so there
is no shuffle and no key that could be hot. The vocabulary travels as one broadcast
value whose size is checked (``MAX_VOCABULARY`` bytes).

Defined cases: null text counts as empty; an empty text has no ids and decodes to
empty bytes; repeated rows each give a row; an empty table gives an empty result;
other columns of the input are kept unless they clash with ``ids``, ``n_tokens`` or
``decoded``, which this operator's results replace.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.llm._io import release

MAX_VOCABULARY = 64 << 20
#: Rows that one recursive query may make.
QUERY_ROWS = 2_000_000
#: Bytes of a word that the recursion takes.
LONG = 1024
#: Distinct text pieces that a worker keeps; where they are more, those of the last texts stay.
CACHE = 400_000
#: Bytes of texts that are put together at once.
SLICE = 3 << 20
IDS = pa.list_(pa.int32())

#: A pair to merge is one number: its rank, then its place.
_CODE = """
WITH RECURSIVE step AS (
  SELECT 0 AS it, s.w, s.pos, s.tok, s.nxt, m.tok * 1099511627776 + s.pos AS cand
  FROM seed s LEFT JOIN merges m ON m.pair = s.tok::BIGINT * 4294967296 + s.nxt
  UNION ALL
  SELECT s.it + 1, s.w, s.pos, s.tok, s.nxt, m.tok * 1099511627776 + s.pos
  FROM (
    SELECT s.it, s.w,
      CASE WHEN s.pos > b.at THEN s.pos - 1 ELSE s.pos END AS pos,
      CASE WHEN s.pos = b.at THEN b.made ELSE s.tok END AS tok,
      CASE WHEN s.pos = b.at - 1 THEN b.made WHEN s.pos = b.at THEN b.after ELSE s.nxt END AS nxt
    FROM step s JOIN (
      SELECT x.w, x.at, x.made, y.nxt AS after
      FROM (SELECT w, (min(cand) % 1099511627776)::INT AS at, (min(cand) // 1099511627776)::INT AS made FROM step GROUP BY w HAVING min(cand) IS NOT NULL) x
      JOIN step y ON y.w = x.w AND y.pos = x.at + 1) b ON b.w = s.w
    WHERE s.pos <> b.at + 1) s
  LEFT JOIN merges m ON m.pair = s.tok::BIGINT * 4294967296 + s.nxt),
done AS (
  SELECT w, pos, tok FROM step SEMI JOIN (SELECT w, max(it) AS it FROM step GROUP BY w) USING (w, it)
  UNION ALL SELECT w, pos, tok FROM finished)
SELECT w, tok::INT AS tok FROM done ORDER BY w, pos
"""


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks from the lines ``base64 rank`` of a .tiktoken file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word by merging its leftmost pair of minimum rank until none is left: a heap of pairs over a linked list."""
    n = len(word)
    part = [word[k : k + 1] for k in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, k, part[k], part[k + 1]) for k in range(n - 1) if (r := ranks.get(part[k] + part[k + 1])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n + 1)
    while heap:
        _, k, left, right = heapq.heappop(heap)
        nxt = after[k]
        if gone[k] or nxt >= n or part[k] != left or part[nxt] != right:
            continue  # one of the two has been merged since
        part[k] = left + right
        gone[nxt] = 1
        after[k] = far = after[nxt]
        if far < n:
            before[far] = k
            if (r := ranks.get(part[k] + part[far])) is not None:
                heapq.heappush(heap, (r, k, part[k], part[far]))
        if (b := before[k]) >= 0 and (r := ranks.get(part[b] + part[k])) is not None:
            heapq.heappush(heap, (r, b, part[b], part[k]))
    return [ranks[part[k]] for k in range(n) if not gone[k]]


class WordCoder:
    """Encodes pre-tokens in an in-memory DuckDB database of one task. A token is its place in the order of ranks; ``tokens`` and ``ranked`` give its bytes and its rank."""

    def __init__(self, raw: bytes) -> None:
        import duckdb

        given = read_ranks(raw)
        self.tokens = sorted(given, key=given.__getitem__)
        self.ranked = [given[t] for t in self.tokens]
        self.ranks = {t: k for k, t in enumerate(self.tokens)}
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs, made = [], []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                left, right = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs.append(left << 32 | right)
                    made.append(rank)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        rows = pa.table({"pair": pa.array(pairs, pa.int64()), "tok": pa.array(made, pa.int64())})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM rows")

    def _rows(self, words: list[bytes]) -> tuple[pa.Table, pa.Table]:
        """Token-position rows of the words: those still to be merged, and finished ones."""
        entry = [self.ranks.get(w) if len(w) <= LONG else None for w in words]
        long_ = {k: merge_long(w, self.ranks) for k, w in enumerate(words) if len(w) > LONG}
        todo = np.array([k for k, r in enumerate(entry) if r is None and k not in long_], np.int32)
        size = np.array([len(words[k]) for k in todo], np.int64)
        tok = self.byte[np.frombuffer(b"".join([words[k] for k in todo]), np.uint8)]
        end = np.cumsum(size)
        last = np.zeros(len(tok), bool)
        last[end - 1] = True
        seed = pa.table({
            "w": pa.array(np.repeat(todo, size)), "pos": pa.array((np.arange(len(tok)) - np.repeat(end - size, size)).astype(np.int32)),
            "tok": pa.array(tok), "nxt": pa.array(np.append(tok[1:], np.int32(0))[: len(tok)], mask=last),
        })
        whole = [k for k, r in enumerate(entry) if r is not None]
        w = np.concatenate([np.array(whole, np.int32), *(np.full(len(x), k, np.int32) for k, x in long_.items())])
        pos = np.concatenate([np.zeros(len(whole), np.int32), *(np.arange(len(x), dtype=np.int32) for x in long_.values())])
        made = np.concatenate([np.array([entry[k] for k in whole], np.int32), *(np.array(x, np.int32) for x in long_.values())])
        return seed, pa.table({"w": w, "pos": pos, "tok": made})

    def encode(self, words: list[bytes]) -> pa.ListArray:
        """The tokens of each word."""
        found, lo, rows = [pa.array([], IDS)], 0, 0
        for k in range(len(words) + 1):
            cost = 0 if k == len(words) else len(words[k]) * (len(words[k]) if len(words[k]) <= LONG else 1) // 2 + 1
            if lo < k and (k == len(words) or rows + cost > QUERY_ROWS):
                seed, finished = self._rows(words[lo:k])  # noqa: F841
                got = self.db.sql(_CODE).to_arrow_table()
                edges = np.searchsorted(got["w"].to_numpy(), np.arange(k - lo + 1))
                if not np.diff(edges).all():
                    raise RuntimeError("words without ids")  # no vocabulary lacks single bytes
                found.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), got["tok"].combine_chunks()))
                lo, rows = k, 0
            rows += cost
        return pa.concat_arrays(found)


def _joined(values: pa.Array, edges: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Runs of a string or binary array as one value each."""
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    return pa.Array.from_buffers(kind, len(edges) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets[edges])), values.buffers()[2] if len(values) else pa.py_buffer(b"")])


class TextCoder:
    """Texts through their distinct pieces.

    A piece is what lies between single spaces. Pre-tokens never cross from one piece into
    the next, the space goes with the piece after it, unless white space meets white space;
    such texts are matched as a whole, and their pre-tokens are their pieces.
    """

    def __init__(self, raw: bytes, pattern: str) -> None:
        import regex

        self.find, self.coder = regex.compile(pattern).findall, WordCoder(raw)
        self.names, self.bytes = pa.array(map(str, self.coder.ranked), pa.string()), pa.array(self.coder.tokens, pa.large_binary())
        self.forget()

    def forget(self) -> None:
        """Keeps no pieces."""
        #: Pieces and words that were met, each once, and their tokens: arrays, as lists of strings would take ten times their memory.
        self.pieces, self.ids = pa.array([], pa.large_string()), pa.array([], IDS)

    def _known(self, pieces: pa.Array, parted: bool) -> pa.ListArray:
        """The tokens of distinct pieces; pieces that are single pre-tokens (not parted) are not matched again."""
        new = pieces.filter(pc.is_null(pc.index_in(pieces, value_set=self.pieces)))
        if len(new):
            cut = [self.find(p) for p in new.to_pylist()] if parted else [[p] for p in new.to_pylist()]
            words = pa.array(chain.from_iterable(cut), pa.large_string()).dictionary_encode()
            at = pc.index_in(words.dictionary, value_set=self.pieces)
            fresh = words.dictionary.filter(pc.is_null(at))
            ids = pa.concat_arrays([self.ids, self.coder.encode([w.encode() for w in fresh.to_pylist()])])
            where = at.fill_null(0).to_numpy().astype(np.int64)
            where[at.is_null().to_numpy(zero_copy_only=False)] = len(self.ids) + np.arange(len(fresh))
            n = np.array([len(ws) for ws in cut])
            several = np.flatnonzero(n != 1)  # a piece of one word is that word
            words_of = ids.take(pa.array(where[words.indices.to_numpy()[np.repeat(n != 1, n)]]))
            edges = words_of.offsets.take(pa.array(np.concatenate([[0], np.cumsum(n[several])])))
            self.ids = pa.concat_arrays([ids, pa.ListArray.from_arrays(edges, words_of.flatten())])
            self.pieces = pa.concat_arrays([self.pieces, fresh, new.take(pa.array(several))])
        at = pc.index_in(pieces, value_set=self.pieces)
        out = self.ids.take(at)
        if len(self.pieces) > CACHE:
            self.pieces, self.ids = pieces, out
        return out

    def __call__(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Ids, decoded bytes and number of ids of each text."""
        cut = pc.split_pattern(texts.cast(pa.large_string()).fill_null(""), " ")
        edges = cut.offsets.to_numpy().astype(np.int64)
        flat = cut.flatten().dictionary_encode()
        names, code = flat.dictionary, flat.indices.to_numpy().astype(np.int64)
        edges = edges - edges[0]
        n = len(edges) - 1
        first = np.zeros(len(code), bool)
        first[edges[:-1]] = True
        initial = pc.utf8_slice_codeunits(names, 0, 1).dictionary_encode()
        blank = np.array([not c or c.isspace() for c in initial.dictionary.to_pylist()], bool)[initial.indices.to_numpy()]
        odd = np.logical_or.reduceat(blank[code] & ~first, edges[:-1]) if n else np.zeros(0, bool)
        # Pieces after a space come with it; a text's first piece may be empty and then counts for nothing.
        empty = pc.binary_length(names).to_numpy() == 0
        use = ~(np.repeat(odd, np.diff(edges)) | (first & empty[code]))
        key = code * 2 + first
        there = np.zeros(2 * len(names), bool)
        there[key[use]] = True
        there = np.flatnonzero(there)
        space = pa.array([" ", ""], pa.large_string())
        ids = self._known(pc.binary_join_element_wise(space.take(pa.array(there & 1)), names.take(pa.array(there >> 1)), space[1]), True)
        place = np.zeros(2 * len(names), np.int64)
        place[there] = np.arange(len(there))
        count = np.add.reduceat(use, edges[:-1], dtype=np.int64) if n else np.zeros(0, np.int64)
        order = place[key[use]]
        if odd.any():
            whole = [self.find(texts[k].as_py()) for k in np.flatnonzero(odd)]
            words = pa.array(chain.from_iterable(whole), pa.large_string()).dictionary_encode()
            starts = np.cumsum(count) - count
            order = np.insert(order, np.repeat(starts[odd], [len(ws) for ws in whole]), len(ids) + words.indices.to_numpy())
            ids = pa.concat_arrays([ids, self._known(words.dictionary, False)])
            count[odd] = [len(ws) for ws in whole]
        taken = ids.take(pa.array(order))
        edges = taken.offsets.to_numpy()[np.concatenate([[0], np.cumsum(count)])]
        tokens = taken.flatten()
        listed = pa.ListArray.from_arrays(pa.array(edges), self.names.take(tokens))
        decoded = _joined(self.bytes.take(tokens), edges, pa.large_binary()).cast(pa.binary())
        return pc.binary_join(listed, " "), decoded, pa.array(np.diff(edges).astype(np.int64))


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """The rows of docs with ``n_tokens`` long, ``ids`` string (decimals joined by one space) and ``decoded`` binary.

    vocabulary: a .tiktoken file of ranks, read on the driver; pattern: the pre-token
    expression. Special tokens' strings are ordinary text. ``decoded`` comes from the ids,
    not from the text. See the module's notes for nulls, empties and clashing names.
    """
    with open(vocabulary, "rb") as f:
        raw = f.read()
    if len(raw) > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary of {len(raw)} bytes is over MAX_VOCABULARY")
    held = docs.sparkSession.sparkContext.broadcast(raw)
    keep = [c for c in docs.columns if c not in ("ids", "n_tokens", "decoded")]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.StringType()), T.StructField("decoded", T.BinaryType())])
    return docs.select(*(F.col(f"`{c}`") for c in keep)).mapInArrow(_coded(held, pattern, text), schema)


#: The coder that a Python worker keeps for the tasks that follow: one vocabulary and pattern, with at most CACHE pieces.
_KEPT: dict[tuple[str, str], TextCoder] = {}


def _coder(raw: bytes, pattern: str) -> TextCoder:
    key = hashlib.sha256(raw).hexdigest(), pattern
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = TextCoder(raw, pattern)
    return _KEPT[key]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows of about SLICE bytes of text together."""
    size = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    group = np.cumsum(size, dtype=np.int64) // SLICE
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    yield from ((a, b - a) for a, b in zip(edges, edges[1:]) if b > a)


def _coded(held, pattern: str, text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or _coder(held.value, pattern)
            for at, n in _slices(batch.column(text)):
                part = batch.slice(at, n)
                ids, raw, count = coder(part.column(text))
                yield pa.RecordBatch.from_arrays([*part.columns, count, ids, raw], [*part.schema.names, "n_tokens", "ids", "decoded"])
        release()

    return run


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes."""
    return coded.select("doc_id", "n_tokens", F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
