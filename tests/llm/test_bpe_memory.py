"""What a coder of byte pairs keeps from text to text."""

import random
import tracemalloc

import pyarrow as pa

from orbweave.llm import bpe, queries


def test_a_coder_keeps_few_bytes_for_a_piece():
    path, pattern = queries.tokenizer()
    coder = bpe.TextCoder(open(path, "rb").read(), pattern)
    rand = random.Random(3)
    text = " ".join("".join(rand.choice("abcdefgh") for _ in range(8)) for _ in range(30_000))
    coder(pa.array(["a b"]))
    tracemalloc.start()
    try:
        before = pa.total_allocated_bytes()
        ids, decoded, n = coder(pa.array([text]))
        assert decoded[0].as_py() == text.encode() and n[0].as_py() == len(ids[0].as_py().split())
        del ids, decoded, n
        held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    finally:
        tracemalloc.stop()
    assert held < 100 * 30_000


def test_a_small_query_gives_the_same_ids(monkeypatch):
    path, pattern = queries.tokenizer()
    raw = open(path, "rb").read()
    texts = pa.array(["one  two three", None, "", "password=abc, déjà vu's 1234\n\n x", "a" * 1200])
    want = [x.to_pylist() for x in bpe.TextCoder(raw, pattern)(texts)]
    monkeypatch.setattr(bpe, "QUERY_ROWS", 1)
    assert [x.to_pylist() for x in bpe.TextCoder(raw, pattern)(texts)] == want
