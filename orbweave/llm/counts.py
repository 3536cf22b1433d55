"""Edit-aware token counts: a segment tree of pre-tokens per document.

A document's pre-tokens are the leaves of a tree whose nodes hold the characters and the
tokens below them. An edit finds its leaves by their characters, starts at the first
pre-token that it can change (the one that ends at the edit or one character before it:
the expression looks no further), matches the expression from there until a pre-token ends
where an old one ended, encodes just those pre-tokens and adds the differences to the sums
above. What lies further on is the same text from the same place, so it is not read again.

Edits of a document are positions in its original text. They are taken in the order of
start, then end; an edit that begins before the end of the one taken before it is passed
over and counted in ``n_passed``. Defined cases: null text counts as empty; null or empty
edit lists leave the count as it is; positions are cut to the text; repeated rows each have
their counts; an empty table gives an empty result; other columns are kept unless they
clash with this operator's.

The count of a pre-token is found once per task with the public tokenizer library and kept
while it is among the last CACHE.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.llm.bpe import MAX_VOCABULARY, read_ranks

CACHE = 400_000
OUT = ("n_tokens", "n_edits", "n_passed", "n_tokens_edited", "n_reencoded", "edited")


class Counter:
    """Tokens of a pre-token."""

    def __init__(self, raw: bytes, pattern: str) -> None:
        import regex
        import tiktoken

        self.find = regex.compile(pattern).findall
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(raw), special_tokens={}).encode_ordinary
        self.known: dict[str, int] = {}

    def counts(self, words: list[str]) -> list[int]:
        known = self.known
        for w in set(words).difference(known):
            known[w] = len(self.encode(w))
        out = [known[w] for w in words]
        if len(known) > CACHE:
            known.clear()
        return out


class Tree:
    """Sums of characters and tokens over a document's pre-tokens."""

    def __init__(self, text: str, counter: Counter) -> None:
        self.counter, self.reencoded = counter, 0
        words = counter.find(text)
        self.leaves: list[list[str]] = [[w] for w in words]
        self.size = 1 << max(0, (len(words) - 1).bit_length())
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        if words:
            self.sums[self.size : self.size + len(words), 0] = [*map(len, words)]
            self.sums[self.size : self.size + len(words), 1] = counter.counts(words)
        at = self.size
        while at > 1:
            self.sums[at // 2 : at] = self.sums[at : 2 * at].reshape(-1, 2, 2).sum(1)
            at //= 2

    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def _leaf(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and the place where the leaf begins."""
        at, before = 1, 0
        while at < self.size:
            at *= 2
            if before + self.sums[at, 0] <= place:
                before += int(self.sums[at, 0])
                at += 1
        return min(at - self.size, max(len(self.leaves) - 1, 0)), before

    def _set(self, leaf: int, words: list[str], tokens: int) -> None:
        self.leaves[leaf] = words
        at = leaf + self.size
        change = np.array([sum(map(len, words)), tokens]) - self.sums[at]
        while at:
            self.sums[at] += change
            at //= 2

    def replace(self, start: int, end: int, new: str) -> None:
        """Characters start to end become new."""
        total = int(self.sums[1, 0])
        start, end = min(start, total), min(end, total)
        if not self.leaves:
            self.leaves = [[]]
        # Pre-tokens that end at start or one character before it may grow.
        lo, begin = self._leaf(max(0, start - 2))
        words: list[str] = []
        hi, had = lo, begin
        while had < end and hi < len(self.leaves) or hi == lo:
            words += self.leaves[hi]
            had += sum(map(len, self.leaves[hi]))
            hi += 1
        more = 1
        while True:
            for _ in range(more):  # what follows, until both agree on an end
                if hi < len(self.leaves):
                    words += self.leaves[hi]
                    had += sum(map(len, self.leaves[hi]))
                    hi += 1
            old = "".join(words)
            text = old[: start - begin] + new + old[end - begin :]
            shift = len(text) - len(old)
            got = self.counter.find(text)
            ends = np.cumsum([*map(len, got)])
            last = hi >= len(self.leaves)
            leaf_ends = begin + np.cumsum([sum(map(len, self.leaves[k])) for k in range(lo, hi)])
            meet = [(int(e), k) for k, e in enumerate(ends) if (last and e == len(text)) or (e <= len(text) - 2 and e + begin - shift >= end and e >= start - begin + len(new))]
            agree = next(((k, int(np.flatnonzero(leaf_ends == e + begin - shift)[-1])) for e, k in meet if e + begin - shift in leaf_ends), None)
            if last and agree is None:
                agree = len(got) - 1, hi - lo - 1
            if agree is not None:
                break
            more *= 2
        fresh = got[: agree[0] + 1]
        self.reencoded += len(fresh)
        self._set(lo, fresh, sum(self.counter.counts(fresh)))
        for k in range(lo + 1, lo + agree[1] + 1):
            if self.leaves[k]:
                self._set(k, [], 0)

    def text(self) -> str:
        return "".join([w for ws in self.leaves for w in ws])


def _counted(held, pattern: str, text: str, edits: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or Counter(held.value, pattern)
            out = []
            for t, changes in zip(batch.column(text).to_pylist(), batch.column(edits).to_pylist(), strict=True):
                t = t or ""
                if not changes:
                    n = sum(counter.counts(counter.find(t)))
                    out.append((n, 0, 0, n, 0, t))
                    continue
                changes = [c for c in changes if c]
                tree, done, shift, passed = Tree(t, counter), 0, 0, 0
                n = tree.tokens()
                for c in sorted(changes, key=lambda c: (c["start"], c["end"])):
                    start, end = max(0, min(c["start"], len(t))), max(0, min(c["end"], len(t)))
                    if start < done or end < start:
                        passed += 1
                        continue
                    new = c["new"] or ""
                    tree.replace(start + shift, end + shift, new)
                    shift += len(new) - (end - start)
                    done = end
                out.append((n, len(changes) - passed, passed, tree.tokens(), tree.reencoded, tree.text()))
            cols = [pa.array([x[k] for x in out], pa.int64() if k < 5 else pa.string()) for k in range(6)]
            keep = [c for c in batch.schema.names if c != edits]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *cols], [*keep, *OUT])

    return run


def count(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", edits: str = "edits") -> DataFrame:
    """The rows of docs without edits, with OUT: tokens before, edits done and passed over, tokens after, pre-tokens encoded again, the edited text.

    edits: array of (start int, end int, new string) in code points of the text, end exclusive.
    """
    with open(vocabulary, "rb") as f:
        raw = f.read()
    if len(raw) > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary of {len(raw)} bytes is over MAX_VOCABULARY")
    keep = [c for c in docs.columns if c not in OUT and c != edits]
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in OUT[:5]), T.StructField("edited", T.StringType())])
    held = docs.sparkSession.sparkContext.broadcast(raw)
    return docs.select(*(F.col(f"`{c}`") for c in [*keep, edits])).mapInArrow(_counted(held, pattern, text, edits), schema)


def redactions(docs: DataFrame, rules: tuple, marks: dict[str, str], text: str = "text", to: str = "edits") -> DataFrame:
    """docs with the edits that put a rule's mark in place of each of its spans; spans inside an earlier one are dropped by ``count``."""
    from orbweave.llm.secrets import scan

    marked = F.create_map(*(F.lit(x) for kv in marks.items() for x in kv))
    found = scan(docs, rules, text)
    return found.withColumn(to, F.transform("secret_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), marked[s["kind"]].alias("new")))).drop("secret_spans")
