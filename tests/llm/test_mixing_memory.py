"""What the scoring of a batch holds at once."""

import tracemalloc

import numpy as np

from orbweave.llm import mixing


def test_costs_hold_few_bytes_for_a_decision():
    rand = np.random.default_rng(5)
    n = 1 << 19
    steps = rand.integers(0, 9, n).astype(np.int32)
    known = rand.integers(-127, 128, 1 << 20).astype(np.int8)
    begin = [rand.integers(0, len(known) - 16, n).astype(np.int32) for _ in range(mixing.INPUTS)]
    start = np.arange(0, n, mixing.STRETCH)
    tracemalloc.start()
    try:
        got = mixing._costs(known, begin, steps, start)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(got) == len(start) and (got > 0).all()
    assert peak < 16 * steps.sum()


def test_predictions_search_once_for_a_step(monkeypatch):
    rand = np.random.default_rng(6)
    code = mixing.Code(rand.integers(0, 1000, 65536))
    pairs = np.unique(rand.integers(0, 50, 20_000).astype(np.uint64) << np.uint64(16) | rand.integers(0, 65536, 20_000).astype(np.uint64) % np.uint64(512))
    rand.shuffle(pairs)
    counts = rand.integers(0, 9, len(pairs))
    asked = []
    search = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *x: asked.append(np.size(v)) or search(a, v, *x))
    got, at = mixing.predictions(code, pairs, counts)
    monkeypatch.undo()
    assert sum(asked) <= len(got) + 2 * len(pairs)
    leaf = code.leaf[(pairs & np.uint64(0xFFFF)).astype(np.int64)].astype(np.uint64)
    for k in rand.integers(0, len(pairs), 300):
        near = pairs >> np.uint64(16) == pairs[k] >> np.uint64(16)
        held = [counts[near & (leaf >= code.below[j, int(leaf[k])]) & (leaf < code.above[j, int(leaf[k])])].sum() for j in range(int(code.steps[int(leaf[k])]) + 1)]
        want = [np.rint(np.clip(np.log((b + 0.05) / (a - b + 0.05)), -8, 8) / mixing.SCALE) for a, b in zip(held, held[1:])]
        assert got[at[k] : at[k] + len(want)].tolist() == want


def test_distinct_numbers_with_and_without_counts(monkeypatch):
    monkeypatch.setattr(mixing, "HELD", 100)
    text = np.frombuffer(b"the cat sat on the mat, extraordinarily so. " * 40 + b"\xff", np.uint8)
    a, b = mixing.Gathered(text, np.ones(1, bool)), mixing.Gathered(text)
    for x in ("last", "pairs", "words"):
        assert (getattr(a, x)[0] == getattr(b, x)[0]).all()
