"""Ropes and the fill-in-middle transformation against plain strings and SQL."""

import hashlib
import random
import re

from orbweave.llm import infill, queries
from tests import oracle

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "Ünïcode 東京 😀 text", "x" * 5000, "1" * 3000 + "ab" * 900, "holds <S> in it", "ends with <", "<P", "a<b>c", "\x00 \x0b tab\tnew\nline", "dup dup dup", "dup dup dup"]


def brute(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text, text
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h4 % 100 < 20
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}", text


def depth_holds(r):
    """Heights are right and neighbours' heights differ by one at most."""
    return r is None or r.text is not None or (abs(r.left.height - r.right.height) <= 1 and r.height == 1 + max(r.left.height, r.right.height) and depth_holds(r.left) and depth_holds(r.right))


def test_ropes_against_strings():
    rand = random.Random(3)
    for _ in range(300):
        text = "".join(rand.choice("ab 1é\n") * rand.choice([1, 1, 2, 400, 1500]) for _ in range(rand.randrange(1, 40)))
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        whole = infill.rope(text)
        assert (whole.units, whole.chars) == (len(units), len(text))
        k, c = rand.randrange(-1, len(units) + 2), rand.randrange(-1, len(text) + 2)
        a, b = infill.split_units(whole, k)
        assert infill.text_of(a) == "".join(units[: max(k, 0)]) and infill.text_of(b) == "".join(units[max(k, 0) :])
        back = infill.joined(b, a)
        assert infill.text_of(back) == infill.text_of(b) + infill.text_of(a)
        assert back.units == len(re.findall("[A-Za-z]+|[^A-Za-z]", infill.text_of(back)))
        x, y = infill.split_chars(back, c)
        assert infill.text_of(x) == infill.text_of(back)[: max(c, 0)] and infill.text_of(x) + infill.text_of(y) == infill.text_of(back)
        assert all(map(depth_holds, (a, b, back, x, y)))


def test_infill(spark):
    rows = [(k, t, "kept") for k, t in enumerate(ODD * 9)] + [(None, "no id at all", "kept"), (7, "again", "kept"), (7, "again", "kept"), (500, "word " * 200_000, "kept")]
    d = spark.createDataFrame(rows, "doc_id long, text string, form string").withColumnRenamed("form", "note").selectExpr("*", "'old' AS form", "1 AS restored")
    got = infill.invert(infill.transform(d))
    assert got.columns == ["doc_id", "text", "note", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got.collect()], key=key) == sorted([(i, *brute(i, t)) for i, t, _ in rows], key=key)
    assert {brute(i, t)[1] for i, t, _ in rows} == {"plain", "psm", "spm"}
    assert infill.digests(infill.invert(infill.transform(d.limit(0)))).count() == 0


def test_infill_on_table(spark):
    oracle.same(queries.op11_infill(spark, SF), oracle.connect(SF), queries.ORACLES["op11_infill"])
