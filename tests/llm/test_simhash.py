"""SimHash near-duplicates against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from orbweave.llm import simhash

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\x00", "a", "A b", "Ünïcode 東京 😀 text", "x" * 5000, "one two three four", "tab\tnew\nline\x0b end\r of it", "dup dup dup dup dup dup dup", "dup dup dup dup dup dup dup", "dup dup dup dup dup dup DUP"]


def brute_print(text):
    words, word = [], b""
    for b in (text or "").encode():
        if b in b" \t\n\r\x0b\x0c":
            words, word = words + [word] * bool(word), b""
        else:
            word += bytes([b + 32 if 65 <= b <= 90 else b])
    words += [word] * bool(word)
    runs = [b" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(r, seed=42).intdigest() for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_classes(rows, radius=4, printed=brute_print):
    prints = [printed(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                root[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return sorted(((d, f"{p:016x}", least.get(find(k))) for k, ((d, _), p) in enumerate(zip(rows, prints))), key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def prose(rand, n):
    return [f"w{rand.randrange(3000)}" for _ in range(n)]


@pytest.mark.parametrize("block", [1 << 16, 5])
def test_classes(spark, block):
    rand = random.Random(5)
    base = prose(rand, 400)
    near = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in range(0, 400, 5)]
    texts = [*ODD, *near, " ".join(base), " ".join(base).upper(), *(" ".join(prose(rand, rand.randrange(1, 60))) for _ in range(60)), " ".join(prose(rand, 40_000))]
    rows = [(7 * k % 1000, t) for k, t in enumerate(texts)] + [(None, "only null ids have it"), (None, " ".join(base)), (3, "other text of an id")]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, fp int, component int")
    out = simhash.classes(d, block=block)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    assert got(out) == brute_classes(rows)
    assert simhash.classes(d.limit(0)).count() == 0


def test_classes_on_table(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert got(simhash.classes(d)) == brute_classes([tuple(r) for r in d.collect()])


def family(rand, centers, around, bits):
    out = []
    for _ in range(centers):
        c = rand.getrandbits(64)
        out += [c] + [c ^ sum({1 << rand.randrange(64) for _ in range(rand.randrange(1, bits))}) for _ in range(around)]
    return sorted(set(out))


def components_of(n, edges):
    label = list(range(n))
    for a, b in edges:
        x, y = label[a], label[b]
        label = [x if v == y else v for v in label]
    return {frozenset(k for k in range(n) if label[k] == v) for v in label}


@pytest.mark.parametrize("bits", [3, 7, 12])
def test_connected_links_what_pairs_link(bits):
    x = np.array(family(random.Random(bits), 4, 150, bits), np.uint64)
    a, b = simhash.connected(x, 4)
    assert (np.bitwise_count(x[a] ^ x[b]) <= 4).all() and len(a) < 20 * len(x)
    every = [(k, j) for k in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x ^ x[k]) <= 4)]
    assert components_of(len(x), zip(a, b)) == components_of(len(x), every)


@pytest.mark.parametrize("radius,depth,block", [(4, 3, 1 << 16), (4, 3, 40), (4, 2, 1 << 16), (4, 4, 1 << 16), (2, 1, 30)])
def test_clusters(spark, radius, depth, block):
    x = family(random.Random(11), 12, 40, 9)
    prints = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in x], "fp long")
    own = [(k, v) for k, v in enumerate(x)]
    want = brute_classes(own, radius, printed=lambda v: v)
    found = {r.id: r.component for r in simhash.clusters(prints, radius, depth, block).collect()}
    signed = [v - (1 << 64) if v >> 63 else v for v in x]
    classes = {}
    for v in signed:
        classes.setdefault(found.get(v, v), set()).add(v)
    expected = {}
    for k, _, c in want:
        expected.setdefault(c, set()).add(signed[k])
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, expected.values()))
    assert all(min(m) == c for c, m in classes.items())


def test_lists_over_batches():
    import pyarrow as pa

    rows = [(p, s, f) for p in range(3) for s in range(4) for f in range(p * s + 1)]
    for size in (1, 2, 3, 7, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + size])], ["p", "s", "f"]) for k in range(0, len(rows), size)]
        out = []
        for columns, edge in simhash._lists(iter(batches), 2):
            out += [[tuple(int(c[k]) for c in columns) for k in range(a, b)] for a, b in zip(edge, edge[1:])] if columns else []
        assert out == [[(p, s, f) for f in range(p * s + 1)] for p in range(3) for s in range(4)]
