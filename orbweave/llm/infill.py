"""Fill-in-middle transformation on ropes.

A text becomes a balanced tree of leaves of at most LEAF code points. Every node caches its
units (letter runs and single other code points) and its code points; as a run may cross a
border between leaves, a node also knows whether its ends are letters, and two neighbours
whose letters meet have one unit less than their sum. The tree is split at two unit ranks,
the parts are concatenated in their new order with sentinels between them, and the inverse
finds the sentinels and splits the tree of the output at their code points. Splits and
concatenations share all leaves but those that a border cuts, and keep the tree's balance,
so they cost the depth of the tree, not the length of the text.

Where a text is cut and how it is arranged follow from the SHA-256 of ``1:`` and the id
alone, so a row gives the same result on every executor and in every run. Rows never meet: nothing is shuffled.

Defined cases: a null text counts as empty and an empty text stays plain; a text that holds
a sentinel stays plain; a null id is hashed as ``1:`` without digits; repeated rows each
have their result; an empty table gives an empty result; columns of the input that clash
with the results are replaced by them, all others are carried along.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAF = 1024
SLICE = 4 << 20  # bytes of text in a batch that a task gives back
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


class Rope:
    """A leaf with its text, or a node with two ropes; never empty: no text is None."""

    __slots__ = ("left", "right", "text", "units", "chars", "opens", "closes", "height")


def _leaf(text: str) -> Rope:
    r = Rope()
    r.left = r.right = None
    r.text, r.chars, r.height = text, len(text), 0
    r.units = len(UNIT.findall(text))
    r.opens, r.closes = text[0] in _LETTERS, text[-1] in _LETTERS
    return r


def _node(a: Rope, b: Rope) -> Rope:
    r = Rope()
    r.left, r.right, r.text = a, b, None
    r.chars, r.units = a.chars + b.chars, a.units + b.units - (a.closes and b.opens)
    r.opens, r.closes, r.height = a.opens, b.closes, 1 + max(a.height, b.height)
    return r


def _leveled(a: Rope, b: Rope) -> Rope:
    """A node of two ropes whose heights differ by two at most, turned once where they do."""
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return _node(a.left, _node(a.right, b))
        return _node(_node(a.left, a.right.left), _node(a.right.right, b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return _node(_node(a, b.left), b.right)
        return _node(_node(a, b.left.left), _node(b.left.right, b.right))
    return _node(a, b)


def joined(a: Rope | None, b: Rope | None) -> Rope | None:
    """a followed by b."""
    if a is None or b is None:
        return b if a is None else a
    if a.height > b.height + 1:
        return _leveled(a.left, joined(a.right, b))
    if b.height > a.height + 1:
        return _leveled(joined(a, b.left), b.right)
    return _node(a, b)


def _halved(leaves: list[Rope]) -> Rope:
    half = len(leaves) // 2
    return leaves[0] if not half else _node(_halved(leaves[:half]), _halved(leaves[half:]))


def rope(text: str) -> Rope | None:
    return _halved([_leaf(text[k : k + LEAF]) for k in range(0, len(text), LEAF)]) if text else None


def split_units(r: Rope | None, rank: int) -> tuple[Rope | None, Rope | None]:
    """The first ``rank`` units and the rest."""
    if r is None or rank <= 0:
        return None, r
    if rank >= r.units:
        return r, None
    if r.text is not None:
        at = next(islice(UNIT.finditer(r.text), rank, None)).start()
        return _leaf(r.text[:at]), _leaf(r.text[at:])
    glued = r.left.closes and r.right.opens  # the last unit of the left goes on in the right
    if rank < r.left.units or (rank == r.left.units and not glued):
        a, b = split_units(r.left, rank)
        return a, joined(b, r.right)
    a, b = split_units(r.right, rank - r.left.units + glued)
    return joined(r.left, a), b


def split_chars(r: Rope | None, at: int) -> tuple[Rope | None, Rope | None]:
    """The first ``at`` code points and the rest."""
    if r is None or at <= 0:
        return None, r
    if at >= r.chars:
        return r, None
    if r.text is not None:
        return _leaf(r.text[:at]), _leaf(r.text[at:])
    if at <= r.left.chars:
        a, b = split_chars(r.left, at)
        return a, joined(b, r.right)
    a, b = split_chars(r.right, at - r.left.chars)
    return joined(r.left, a), b


def text_of(r: Rope | None) -> str:
    out, todo = [], [] if r is None else [r]
    while todo:
        x = todo.pop()
        if x.text is not None:
            out.append(x.text)
        else:
            todo += (x.right, x.left)
    return "".join(out)


def _chars(r: Rope | None) -> int:
    return 0 if r is None else r.chars


def rearranged(doc_id: int | None, text: str, rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle (None if plain), and the output."""
    whole = rope(text)
    n = 0 if whole is None else whole.units
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))
    if not n or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, rest = split_units(whole, first)
    middle, suffix = split_units(rest, second - first)
    form = "spm" if h4 % 100 < spm else "psm"
    parts = (_leaf(SUFFIX), suffix, _leaf(PREFIX), prefix, _leaf(MIDDLE), middle) if form == "spm" else (_leaf(PREFIX), prefix, _leaf(SUFFIX), suffix, _leaf(MIDDLE), middle)
    out = None
    for p in parts:
        out = joined(out, p)
    return n, form, _chars(prefix), _chars(middle), text_of(out)


def restored(output: str, form: str) -> str:
    """The text before it was rearranged: the tree of the output, split at its sentinels.

    Parts hold no sentinel, and a sentinel's ends occur once in it, so none can arise where
    a part and a sentinel meet: each is found where it was put.
    """
    if form == "plain":
        return output
    order = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    whole, at, found = rope(output), 0, {}
    places = []
    for s in order:
        at = output.index(s, at)
        places.append(at)
        at += len(s)
    rest = whole
    for s, at in zip(order[::-1], places[::-1], strict=True):
        rest, tail = split_chars(rest, at)
        found[s] = split_chars(tail, len(s))[1]
    return text_of(joined(joined(found[PREFIX], found[MIDDLE]), found[SUFFIX]))


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about SLICE bytes of text."""
    size = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    group = np.cumsum(size, dtype=np.int64) // SLICE
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(size)]
    yield from (batch.slice(a, b - a) for a, b in zip(edges, edges[1:]) if b > a)


def _made(df: DataFrame, fields: list[T.StructField], text: str, make: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """The columns of df, but those named as a field, and the fields that ``make`` gives for each run of rows."""
    names = [f.name for f in fields]
    keep = [c for c in df.columns if c.lower() not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, text):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *make(part)], [*keep, *names])

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), *fields]))


def transform(docs: DataFrame, rate: int = 90, spm: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    rate: of 100 texts so many are rearranged; spm: of 100 of those so many begin with the suffix.
    """
    fields = [T.StructField(c, t) for c, t in (("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType()))]

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        rows = [rearranged(d, t or "", rate, spm) for d, t in zip(part.column(key).to_pylist(), part.column(text).to_pylist(), strict=True)]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]

    return _made(docs, fields, text, make)


def invert(rows: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """The rows with ``restored``: the text that each output and form were made from."""

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([restored(o, f) for o, f in zip(part.column(output).to_pylist(), part.column(form).to_pylist(), strict=True)], pa.string())]

    return _made(rows, [T.StructField("restored", T.StringType())], output, make)


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, n, form, code points of prefix and middle, and the digests of output and restored text."""
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(F.col("restored"), 256).alias("restored_sha256"))
