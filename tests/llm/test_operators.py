"""The ten operators against brute force on small tables, and their edge cases."""

import hashlib
import itertools
import math
import re
import time
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orbweave.llm import bpe, components, counts, decontaminate, jaccard, mixing, quality, queries, secrets, sharding, suffixes, topk
from tests import oracle

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def words(seed, n):
    """n words in a fixed order that depends on the seed."""
    return " ".join(WORDS[zlib.crc32(f"{seed}:{k}".encode()) % len(WORDS)] + str(zlib.crc32(f"{k}:{seed}".encode()) % 50) for k in range(n))


def docs(spark, texts, first=0):
    """doc_id and text, with a column whose name may clash."""
    return spark.createDataFrame([(first + k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, size int")


ODD = [None, "", " ", "a", "Ünïcode 東京 😀 text", "x" * 5000, "one two three four", "\x00 \x0b tab\tnew\nline", "dup dup dup", "dup dup dup"]


def small(spark):
    base = words("base", 120)
    near = base.split()
    near[60] = "changed"
    return docs(spark, [*ODD, base, base, " ".join(near), words("other", 150), base.upper(), words("long", 900), words("long", 905)])


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_classes(rows):
    sets = [(r.doc_id, shingles(r.text)) for r in rows]
    least = {d: d for d, _ in sets}

    def root(d):
        while least[d] != d:
            d = least[d]
        return d

    for (a, s), (b, t) in itertools.combinations(sets, 2):
        if s and t and 100 * len(s & t) >= 75 * len(s | t):
            x, y = sorted((root(a), root(b)))
            least[y] = x
    return sorted((d, len(s), root(d)) for d, s in sets)


@pytest.mark.parametrize("few", [2, 24])
def test_jaccard_join(spark, few):
    copies = [words("group", 60).split() for _ in range(40)]
    for k, w in enumerate(copies):
        w[k] = f"own{k}"
    d = small(spark).unionByName(docs(spark, [" ".join(w) for w in copies], 100))
    got = sorted(map(tuple, jaccard.Join(d, few=few).classes().collect()))
    assert got == brute_classes(d.collect())
    assert jaccard.classes(d.limit(0)).count() == 0


def test_jaccard_deals_a_hub_to_blocks(spark):
    pairs = spark.range(5000).select(F.lit(-1).cast("long").alias("a"), F.col("id").alias("b"))
    pairs = pairs.unionAll(spark.range(3000).select((F.col("id") + 10_000).alias("a"), F.lit(50_000).cast("long").alias("b")))
    dealt = jaccard._dealt(pairs, jaccard._heavy(pairs))
    got = {(r.a, r.b) for r in dealt.collect()}
    assert got == {(-1, k) for k in range(5000)} | {(50_000, k + 10_000) for k in range(3000)} and dealt.count() == 8000
    for c in (["a", "block"], ["b"]):
        assert dealt.groupBy(*c).count().agg(F.max("count")).first()[0] <= 1.5 * jaccard.BLOCK


def test_jaccard_sends_equal_sets_once():
    import pyarrow as pa

    def sent(texts):
        batches = [pa.RecordBatch.from_pydict({"text": texts[k : k + 100]}) for k in range(0, len(texts), 100)]
        return sum(len(x) // 5 for b in jaccard._send(jaccard.Bands(3, 4), 5, 8)(iter(batches)) for x in b.column("sigs").to_pylist())

    one, two = words("one", 80), words("two", 90)
    assert sent([one, two] * 200) == sent([one, two]) > 0


def test_jaccard_on_table(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert sorted(map(tuple, jaccard.classes(d).collect())) == brute_classes(d.collect())


def test_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 50), (50, 100), (7, 7), (200, 100)], "a long, b long")
    got = dict(map(tuple, components.components(e).collect()))
    assert got == {**dict.fromkeys(range(31), 0), 50: 50, 100: 50, 200: 50}
    assert components.components(e.limit(0)).count() == 0


def brute_removed(rows, span):
    raw = [(r.text or "").encode() for r in rows]
    seen = Counter(t[p : p + span] for t in raw for p in range(len(t) - span + 1))
    out = []
    for r, t in zip(rows, raw):
        gone = [False] * len(t)
        for p in range(len(t) - span + 1):
            if seen[t[p : p + span]] > 1:
                gone[p : p + span] = [True] * span
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((r.doc_id, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("many", [2, 4096])
def test_suffix_dedup(spark, many):
    passage = words("passage", 60)
    texts = [*ODD, *(words(k, 40) + " " + passage + " " + words(-k, 30) for k in range(1, 9)), "ab" * 700, words("solo", 300), words("twice", 200), words("twice", 200), passage[:399], "y " + passage[:400]]
    d = docs(spark, texts)
    found = suffixes.repeats
    try:
        suffixes.repeats = lambda *a, **k: found(*a, **k, many=many)
        got = sorted(map(tuple, suffixes.digests(suffixes.remove(d)).collect()))
    finally:
        suffixes.repeats = found
    assert got == brute_removed(d.collect(), 400)
    assert suffixes.remove(d.limit(0)).count() == 0


def test_suffix_dedup_on_table(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(map(tuple, suffixes.digests(suffixes.remove(d)).collect())) == brute_removed(d.collect(), 400)


def test_top_k(spark):
    con = oracle.connect(SF)
    oracle.same(queries.op1_top_k(spark, SF), con, queries.ORACLES["op1_top_k"])
    v = spark.createDataFrame([(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 0.0]), (5, [-1.0, 2.0]), (6, []), (7, [1.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(v, v.where("vec_id % 50 = 0"), 3).collect())
    assert got == [(0, 1, 1, 256 * 256 + 128 * 128), (0, 2, 7, 65536), (0, 3, 5, 0)]
    assert topk.top_k(v.limit(0), v, 3).count() == 0


def test_secrets(spark):
    con = oracle.connect(SF)
    oracle.same(queries.op8_secret_scans(spark, SF), con, queries.ORACLES["op8_secret_scans"])
    d = docs(spark, [*ODD, "Password: \"abcdef1\" and x", "token = abc", "AKIA" + "A" * 16 + " AKIAB", "e" * 24 + " " + "f" * 23, "😀 secret=ABCDEF/9 key ſecret=abcdefg"])
    got = {r.doc_id: r.spans for r in secrets.digests(secrets.scan(d)).collect()}
    n = len(ODD)
    assert [got[n + k] for k in range(5)] == ["assign:0:18", "", "access:0:20", "hex:0:24", "assign:2:17"] and got[0] == ""
    clean = {r.doc_id: r.text for r in secrets.redact(secrets.scan(d)).collect()}
    assert clean[0] is None and clean[n + 4].startswith("😀 [SECRET] key")
    assert secrets.scan(d.limit(0)).count() == 0


def test_sharding(spark):
    d = small(spark).unionByName(docs(spark, ["same text"] * 300, 1000))
    got = sharding.pack(d, 4).collect()
    text = {r.doc_id: r.text for r in d.collect()}
    assert sorted(r.doc_id for r in got) == sorted(text)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "bytes")
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in by.values())
    assert sharding.pack(d.limit(0), 4).count() == 0


def test_sharding_balances_bytes(spark):
    got = sharding.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 24).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = [r.b for r in got]
    assert len(sizes) == 24 and max(sizes) <= 1.1 * sum(sizes) / 24


def test_bpe_against_tiktoken(spark):
    import tiktoken

    path, pattern = queries.tokenizer()
    enc = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=bpe.read_ranks(open(path, "rb").read()), special_tokens={})
    d = small(spark).select("doc_id", "text").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    text = {r[0]: r[1] or "" for r in d.collect()}
    for r in bpe.encode_decode(d, path, pattern).collect():
        ids = enc.encode_ordinary(text[r.doc_id])
        assert r.ids == " ".join(map(str, ids)) and r.n_tokens == len(ids) and bytes(r.decoded) == text[r.doc_id].encode()


def test_bpe_of_long_words_and_clashing_names(spark):
    import random

    import tiktoken

    path, pattern = queries.tokenizer()
    enc = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=bpe.read_ranks(open(path, "rb").read()), special_tokens={})
    letters = random.Random(7)
    long_ = ["".join(letters.choice("abcdeé") for _ in range(n)) for n in (1000, bpe.LONG + 1, 40_000)]
    texts = [*long_, "ab" * 100_000, "!" * 5000, "a" * bpe.LONG, f" {long_[1]}  {long_[1]} ", "two  blanks", " lead", "trail ", " \n ", "\u00a0x \u00a0y"]
    d = spark.createDataFrame([(k, t, b"raw", k, "old") for k, t in enumerate(texts)], "doc_id long, text string, decoded binary, n_tokens int, extra string")
    got = bpe.encode_decode(d, path, pattern)
    assert got.columns == ["doc_id", "text", "extra", "n_tokens", "ids", "decoded"]
    for r in got.collect():
        ids = enc.encode_ordinary(r.text)
        assert r.ids == " ".join(map(str, ids)) and r.n_tokens == len(ids) and bytes(r.decoded) == r.text.encode()


def test_bpe_forgets_pieces_by_generations(monkeypatch):
    import pyarrow as pa

    path, pattern = queries.tokenizer()
    coder = bpe.TextCoder(open(path, "rb").read(), pattern)
    texts = pa.array([words(k, 40) for k in range(60)])
    want = [x.to_pylist() for x in coder(texts)]
    monkeypatch.setattr(bpe, "CACHE", 20)
    small_ = bpe.TextCoder(open(path, "rb").read(), pattern)
    got = [[x.to_pylist() for x in small_(texts.slice(k, 1))] for k in range(60)]
    assert [[g[c][0] for g in got] for c in range(3)] == want


def test_token_counts_follow_edits(spark):
    import tiktoken

    path, pattern = queries.tokenizer()
    enc = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=bpe.read_ranks(open(path, "rb").read()), special_tokens={})
    d = docs(spark, [*ODD, "mail me at a.b@example.org now", "password=abcdefgh1 and password=zyxwvut9, " + words("t", 500)]).select("doc_id", "text")
    edited = counts.redactions(d, (*secrets.RULES, queries.EMAIL), queries.MARKS)
    after = {r.doc_id: r.text or "" for r in secrets.redact(secrets.scan(d, rules=(queries.EMAIL,)), mark="[EMAIL]").collect()}
    text = {r.doc_id: r.text or "" for r in d.collect()}
    got = {r.doc_id: r for r in counts.count(edited, path, pattern).collect()}
    for k, t in text.items():
        assert got[k].n_tokens == len(enc.encode_ordinary(t))
    mail = len(ODD)
    assert got[mail].n_tokens_edited == len(enc.encode_ordinary(after[mail])) and got[mail].n_edits == 1
    want = text[mail + 1].replace("password=abcdefgh1", "[SECRET]").replace("password=zyxwvut9", "[SECRET]")
    assert got[mail + 1].n_tokens_edited == len(enc.encode_ordinary(want)) and got[mail + 1].n_reencoded < got[mail + 1].n_tokens / 4


def test_lm_base_score(spark):
    d = small(spark)
    rows = d.collect()
    tok = {r.doc_id: [*re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (r.text or "").encode())), None] for r in rows}
    train = Counter(w for r in rows if zlib.crc32(str(r.doc_id).encode()) % 10 for w in tok[r.doc_id])
    n, v = sum(train.values()), len(train)
    for r in mixing.score(d).collect():
        own = tok[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(train[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
        assert r.score <= 0
    assert mixing.score(d.limit(0)).count() == 0


def brute_lm(rows):
    """Scores from a dict of counts for every context and node, weights moved after every decision."""
    import numpy as np

    space = {0x20, *range(0x09, 0x0E)}

    def symbols(t):
        return [*(t or "").encode(), mixing.END]

    def seen_at(t, p):
        back = [mixing.END] * mixing.REACH + t[:p]
        begin = max((k + 1 for k in range(p) if t[k] in space), default=0)
        long_ = p - begin >= mixing.REACH
        begin += (p - begin) // mixing.WORD * mixing.WORD
        lower = [b + 32 if 65 <= b <= 90 else b for b in t[begin:p]]
        return [*((o, *back[-o:]) for o in mixing.ORDERS), ("word", long_, *lower, back[-1])]

    training = [symbols(r.text) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 10]
    follows = np.zeros((256, 256), np.int64)
    for t in training:
        for x, y in itertools.pairwise([mixing.END, *t]):
            follows[x, y] += 1
    code = mixing.Code(follows.reshape(-1))

    def walk(before, byte):
        leaf = int(code.leaf[before << 8 | byte])
        for j in range(int(code.steps[leaf])):
            below = tuple(int(x) for x in (code.below[j, leaf], code.above[j, leaf]))
            yield below, tuple(int(x) for x in (code.below[j + 1, leaf], code.above[j + 1, leaf]))

    count = Counter()
    for t in training:
        for p, b in enumerate(t):
            before = t[p - 1] if p else mixing.END
            count.update((c, node) for c in seen_at(t, p) for node in [(before << 8, (before << 8) + 256), *(x for _, x in walk(before, b))])
    out = {}
    for r in rows:
        t, cost = symbols(r.text), 0.0
        for p, b in enumerate(t):
            if p % mixing.STRETCH == 0:
                weights = {g: [mixing.START] * mixing.INPUTS for g in range(4)}
            gate = None
            for node, inner in walk(t[p - 1] if p else mixing.END, b):
                odds = [math.log((count[c, inner] + 0.05) / (count[c, node] - count[c, inner] + 0.05)) for c in seen_at(t, p)]
                odds = [round(max(-8, min(8, x)) / mixing.SCALE) * mixing.SCALE for x in odds]
                gate = (odds[-2] != 0) * 2 + (odds[-1] != 0) if gate is None else gate
                w = weights[gate]
                z = sum(map(float.__mul__, w, odds))
                cost += math.log1p(math.exp(-z))
                w[:] = [v + mixing.RATE * x / (1 + math.exp(z)) for v, x in zip(w, odds)]
        out[r.doc_id] = -cost / math.log(10)
    return out


def test_lm_against_a_slow_mixer(spark, monkeypatch):
    d = docs(spark, [*ODD[:5], *ODD[6:], "short", "end ", *(words(k, 60) for k in range(24)), words(3, 60), words(4, 700), "x" * 200 + "y" * 70, "A b\u00e9 A B\u00c9"])
    want = brute_lm(d.collect())
    got = {r.doc_id: r.score for r in mixing.score(d.repartition(3)).collect()}
    assert got == pytest.approx(want, rel=1e-3, abs=1e-3)
    # Blocks, batches and flocks of any size give the same scores.
    monkeypatch.setattr(mixing.tx, "BLOCK", 100)
    monkeypatch.setattr(mixing, "PART", 70)
    monkeypatch.setattr(mixing, "HELD", 500)
    import numpy as np

    data, off = mixing.tx.utf8(__import__("pyarrow").array([r.text for r in d.collect()]))
    text = mixing.stream(data, off)
    found = mixing.Gathered(text, np.array([zlib.crc32(str(r.doc_id).encode()) % 10 != 0 for r in d.collect()]))
    (last, n_last), (long_words, n_long) = found.last, found.pairs
    asked = mixing.Asked(last, long_words)
    code = mixing.Code(np.bincount((last & np.uint64(0xFFFF)).astype(np.int64), n_last, 65536).astype(np.int64))
    known, _ = mixing.predictions(code, asked.pairs, asked.sums(n_last, n_long))
    cost = mixing.costs(known, mixing.Begin(asked, code, last, long_words), code, text, off)
    assert (-cost / np.log(10)).tolist() == pytest.approx([want[r.doc_id] for r in d.collect()], rel=1e-3, abs=1e-3)


def test_lm_code_is_a_whole_tree():
    import numpy as np

    follows = np.random.default_rng(3).zipf(1.5, 65536).astype(np.int64) * (np.arange(65536) % 5 > 0)
    code = mixing.Code(follows)
    assert (2.0 ** -code.steps.reshape(256, 256)).sum(1) == pytest.approx(np.ones(256))
    assert sorted(code.leaf) == list(range(65536)) and (code.leaf >> 8 == np.arange(65536) >> 8).all()


def test_lm_model_grows():
    """Two million pairs of context and byte are all told apart: what followed one says nothing of another."""
    import numpy as np

    code = mixing.Code(np.zeros(65536, np.int64))
    pairs = np.sort(np.random.default_rng(1).choice(1 << 40, 2_000_000, replace=False).astype(np.uint64)) << np.uint64(16) | np.uint64(0x6107)
    known, at = mixing.predictions(code, pairs, np.ones(len(pairs), np.int64))
    assert len(known) == len(pairs) * code.walk[0x6107] and set(known.tolist()) == {round(math.log(1.05 / 0.05) / mixing.SCALE)}
    assert (mixing.Table(pairs)(pairs[::-3]) == np.arange(len(pairs))[::-3]).all()


def test_lm_beats_a_uniform_code(spark):
    got = queries.op9_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out AND bits_per_byte IS NOT NULL").agg(F.avg("bits_per_byte")).first()[0]
    assert got < 4


def test_quality_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.report(quality.score(d, labels)).join(labels, "doc_id").where("held_out")
    right, n = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.count("*")).first()
    assert n > 100 and right >= 0.9


def test_quality_edges(spark):
    d = docs(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(d, none).collect()} == {0.5}
    assert quality.score(d.limit(0), none).count() == 0


def brute_leaks(rows, items):
    split = lambda t: re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").encode().lower())
    out = set()
    for r in rows:
        w = split(r.text)
        for i in items:
            q = split(i.text)
            if not q or not w:
                continue
            width = min(5, len(q))
            want = Counter(tuple(q[k : k + width]) for k in range(len(q) - width + 1))
            n = min(len(q), len(w))
            for s in range(len(w) - n + 1):
                have = Counter(tuple(w[k : k + width]) for k in range(s, s + n - width + 1))
                both = sum((have & want).values())
                if both and both / (sum(have.values()) + sum(want.values()) - both) >= 0.75:
                    out.add((r.doc_id, i.item_id))
                    break
    return out


def test_decontamination(spark):
    item = words("item", 40)
    near = item.split()
    near[20] = "other"
    d = docs(spark, [*ODD, words(1, 100) + " " + item + " " + words(2, 50), words(3, 30) + " " + " ".join(near) + "; " + words(4, 30), words(5, 400), item[: len(item) // 2], "so one two three four it is"])
    bench = spark.createDataFrame([(1, item), (2, "one two three four"), (3, None), (4, ""), (5, words("unseen", 60))], "item_id long, text string")
    got = decontaminate.find(d.select("doc_id", "text"), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == brute_leaks(d.collect(), bench.collect())
    left = {r.doc_id for r in decontaminate.clean(d, bench).collect()}
    assert left == {r.doc_id for r in d.collect()} - {r.doc_id for r in got.collect()}
    assert decontaminate.find(d.select("doc_id", "text"), bench.limit(0)).count() == 0


def test_decontamination_of_passages_cut_off_at_the_threshold(spark):
    """All differing words at one end, similarity just 0.75 or more; fingerprints of these are 32 to 35 bits apart."""
    seeds = [14, 75, 252, 266, 318, 513, 1093, 1135]
    bench = spark.createDataFrame([(k, words(f"cut{k}", 60)) for k in seeds], "item_id long, text string")
    d = docs(spark, [" ".join(words(f"cut{k}", 60).split()[:52]) + " " + words(f"else{k}", 8) for k in seeds])
    want = brute_leaks(d.collect(), bench.collect())
    assert len(want) == len(seeds)
    assert {(r.doc_id, r.item_id) for r in decontaminate.find(d.select("doc_id", "text"), bench).collect()} == want
    assert decontaminate.clean(d, bench).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    d = spark.read.parquet(f"{SF}/documents.parquet")
    kept = stages["near_copies"](spark, d, SF)
    want = {c for _, _, c in brute_classes(d.select("doc_id", "text").collect())}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == d.columns
    marked = stages["secrets"](spark, kept, SF)
    assert secrets.scan(marked).where("size(secret_spans) > 0").count() == 0 and marked.columns == d.columns
    assert stages["benchmark"](spark, kept, SF).columns == d.columns
    assert corpus_pipeline.run(spark, SF).count() <= kept.count()


CLASH = ("may", "_k1", "_k2", "k1", "k2", "score", "_rank", "class", "quality", "secret_spans", "flock", "anchor", "size", "of", "rank")


def test_operators_take_clashing_columns(spark):
    """Columns that bear the names of inner ones change nothing."""
    plain = small(spark).select("doc_id", "text")
    odd = plain.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASH)))
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(17)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, words("base", 120))], "item_id long, text string")
    path, pattern = queries.tokenizer()
    for run in (
        lambda d: secrets.digests(secrets.scan(d)), lambda d: secrets.redact(secrets.scan(d)).select("doc_id", "text"), lambda d: suffixes.digests(suffixes.remove(d)),
        lambda d: jaccard.classes(d), lambda d: sharding.pack(d, shards=3), lambda d: quality.report(quality.score(d, labels)), lambda d: decontaminate.find(d, items),
        lambda d: bpe.digests(bpe.encode_decode(d, path, pattern)), lambda d: mixing.score(d).select("doc_id", "n_known", "base_score"),
        lambda d: counts.count(counts.redactions(d, (*secrets.RULES, queries.EMAIL), queries.MARKS), path, pattern).select("doc_id", "n_tokens", "edited"),
    ):
        a, b = (sorted(map(str, run(d).collect())) for d in (plain, odd))
        assert a == b


def test_pipeline_keeps_other_texts_of_a_repeated_id(spark):
    import corpus_pipeline

    a, b, c = words("a", 60), words("b", 60), words("c", 60)
    rows = [(3, a), (5, a), (5, b), (5, b), (None, a), (None, c), (7, None), (7, None), (8, "")]
    for extra in ([], ["_rank", "score", "k1", "class"]):
        d = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(k).alias(x) for k, x in enumerate(extra)))
        got = corpus_pipeline.near_copies(spark, d, SF)
        assert got.columns == d.columns
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(3, a), (5, b), (None, c), (7, None), (8, "")], key=str)
        assert corpus_pipeline.near_copies(spark, d.limit(0), SF).count() == 0
        assert corpus_pipeline.secret_marks(spark, d, SF).columns == d.columns
    d = spark.createDataFrame([(1, "x", 0.25), (2, None, None)], "doc_id long, text string, score double")
    kept = corpus_pipeline.quality(spark, d, SF)
    assert kept.columns == d.columns and {r.score for r in kept.collect()} <= {0.25, None}


def test_top_k_of_huge_components_and_repeated_ids(spark):
    rows = [(50, [3e38, 1.0]), (100, [1.0, 2.0]), (100, [2.0, -1.0]), (100, [2.0, -1.0]), (1, [-3e38, 0.0]), (2, [0.5, 0.5]), (3, [1e15, 3.0]), (4, None), (5, [float("nan"), 1.0]), (None, [1.0, 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    top = (1 << 63) - 1
    fixed = [(i, [max(-top - 1, min(top, math.floor(256 * x))) for x in spark.createDataFrame([(v,)], "v array<float>").first()[0]]) for i, v in rows if i is not None and v is not None and v[0] == v[0]]
    want = []
    for i, q in dict.fromkeys((i, tuple(v)) for i, v in fixed if i % 50 == 0):
        found = sorted((-max(-top - 1, min(top, sum(a * b for a, b in zip(q, v)))), j) for j, v in fixed if j != i)[:5]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    got = topk.top_k(d, d.where("vec_id % 50 = 0"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_decontamination_of_null_and_string_items(spark):
    d = docs(spark, [words("other", 80), "some words before " + words("leak", 60) + " and after", None, ""])
    items = spark.createDataFrame([("a", words("leak", 60)), (None, words("other", 80)), ("b", None), ("c", "")], "item_id string, text string")
    got = decontaminate.find(d, items)
    assert sorted((r.doc_id, str(r.item_id)) for r in got.collect()) == [(0, "None"), (1, "a")]
    assert sorted(r.doc_id for r in decontaminate.clean(d, items).collect()) == [2, 3]


def test_token_counts_of_null_edits(spark):
    path, pattern = queries.tokenizer()
    d = spark.createDataFrame([(1, "one two", [None, (0, 3, "1"), None])], "doc_id long, text string, edits array<struct<start:int,end:int,new:string>>")
    r = counts.count(d, path, pattern).first()
    assert (r.n_edits, r.n_passed, r.edited) == (1, 0, "1 two")


def test_jaccard_confronts_in_columns(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    base = rng.integers(1, 1 << 60, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: 200 - k], rng.integers(1, 1 << 60, k).astype(np.uint64)])) for k in range(0, 60, 3)]
    t = pa.table({"sid": pa.array(range(len(sets)), pa.int64()), "component": pa.array(range(len(sets)), pa.int64()), "grams": pa.array([s.tobytes() for s in sets], pa.binary())})
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and 4 * len(np.intersect1d(a, b)) >= 3 * len(np.union1d(a, b))}
    for columns in (7, 1 << 15):
        monkeypatch.setattr(jaccard, "COLUMNS", columns)
        got = jaccard._confront(3, 4)((), t, t)
        assert set(zip(got["a"].to_pylist(), got["b"].to_pylist())) == want


def test_address_rule_in_long_texts(spark):
    d = docs(spark, ["x" * 1_000_000, "a@" * 200_000, "to a.b@c.org and " + "y" * 300_000 + "@d.example.net", "x@y", "@"])
    began = time.perf_counter()
    found = {r.doc_id: [s.kind for s in r.secret_spans] for r in secrets.scan(d, rules=(queries.EMAIL,)).collect()}
    assert found == {0: [], 1: [], 2: ["email", "email"], 3: [], 4: []}
    assert time.perf_counter() - began < 30
