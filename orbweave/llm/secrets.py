"""Secret scans: a trigram inverted index picks the texts that a rule's expression can match.

Each rule's regular expression is read once on the driver into a Boolean query over
trigrams (a list of alternatives, each a set of trigrams that must all occur). The index
holds postings (trigram, text key) for the trigrams that any rule asks for; intersecting
the postings gives each rule's candidate texts, and only those are searched with the
expression. A rule without mandatory trigrams searches every text. Equal texts share one
posting. Only DataFrame functions run; positions come from the lengths of what lies
between and inside the matches.

Defined cases: null text counts as empty and has no spans; matches are leftmost and do not
overlap within a rule; spans are in code points, end exclusive; repeated rows are scanned
as rows of their own; an empty table gives an empty result; columns of the input that clash
with ``secret_spans`` are replaced by it.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.llm._io import cut, fresh, text_key


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose group ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # as [0-9a-f]+ with shorter runs dropped: matches are whole runs
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("google", r"AIza[0-9A-Za-z_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20),
)
RULES = BASE + MORE

#: Alternatives, each the trigrams that must all occur; None: any text may match.
Query = frozenset[frozenset[str]] | None
MOST = 64


def _exact(node: tuple) -> set[str] | None:
    """The strings that a node matches, if they are few."""
    kind, arg = node
    if kind is sre.LITERAL:
        return {chr(arg)}
    if kind is sre.IN and len(arg) <= 5 and all(k is sre.LITERAL for k, _ in arg):
        return {chr(c) for _, c in arg}
    if kind is sre.SUBPATTERN:
        return _run(arg[-1])
    if kind is sre.BRANCH:
        found = [_run(x) for x in arg[1]]
        return set().union(*found) if all(x is not None for x in found) else None
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] is not sre.MAXREPEAT and arg[1] <= 4:
        one = _run(arg[2])
        if one is None:
            return None
        out, last = ({""} if arg[0] == 0 else set()), {""}
        for k in range(1, arg[1] + 1):
            last = {a + b for a in last for b in one}
            if len(last) > MOST:
                return None
            out |= last if k >= arg[0] else set()
        return out
    return None


def _run(nodes) -> set[str] | None:
    out = {""}
    for x in nodes:
        one = _exact(x)
        if one is None or len(out) * len(one) > MOST:
            return None
        out = {a + b for a in out for b in one}
    return out


def _absorb(alternatives: set[frozenset[str]]) -> Query:
    return None if frozenset() in alternatives else frozenset(a for a in alternatives if not any(b < a for b in alternatives))


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return a if b is None else b
    return a if len(a) * len(b) > MOST * MOST else _absorb({x | y for x in a for y in b})


def _either(found: list[Query]) -> Query:
    return None if any(x is None for x in found) else _absorb(set().union(*found))


def _strings(strings: set[str]) -> Query:
    return _absorb({frozenset(s.lower()[k : k + 3] for k in range(len(s) - 2)) for s in strings})


def _nodes(nodes) -> Query:
    query: Query = None
    strings = {""}
    for x in [*nodes, None]:
        one = _exact(x) if x is not None else None
        if one is not None and len(strings) * len(one) <= MOST:
            strings = {a + b for a in strings for b in one}
            continue
        query = _both(query, _strings(strings))
        strings = {""} if one is None else one
        if x is not None and one is None:
            kind, arg = x
            if kind is sre.SUBPATTERN:
                query = _both(query, _nodes(arg[-1]))
            elif kind is sre.BRANCH:
                query = _both(query, _either([_nodes(y) for y in arg[1]]))
            elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                query = _both(query, _nodes(arg[2]))
    return query


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that every match of pattern satisfies, over lower-cased text."""
    return _nodes(sre_parser.parse(pattern))


def postings(docs: DataFrame, trigrams: list[str], text: str = "text") -> DataFrame:
    """The inverted index for the given trigrams: trigram, k1, k2; k1 and k2 stand for the text."""
    k1, k2 = text_key(text)
    low = docs.select(k1.alias("k1"), k2.alias("k2"), F.lower(F.col(text)).alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return low.select("k1", "k2", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """Texts whose postings meet a query: k1, k2 and the kinds that may match there."""
    texts = index.groupBy("k1", "k2").agg(F.collect_set("trigram").alias("have"))
    meets = {
        kind: reduce(lambda a, b: a | b, (F.size(F.array_intersect("have", F.array(*map(F.lit, sorted(need))))) == len(need) for need in query))
        for kind, query in queries.items()
        if query is not None
    }
    kinds = F.array_compact(F.array(*(F.when(ok, F.lit(kind)) for kind, ok in meets.items())))
    return texts.select("k1", "k2", kinds.alias("may")).where(F.size("may") > 0)


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    pattern = F.lit(("(?i)" if rule.any_case else "") + rule.pattern)
    hits, held = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))
    between = F.split(text, pattern, -1)
    steps = F.arrays_zip(F.transform(between, F.length).alias("gap"), F.transform(hits, F.length).alias("size"), F.transform(held, F.length).alias("held"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    found = F.aggregate(
        steps, F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + F.coalesce(x["size"], F.lit(0))).alias("at"),
            F.when(x["held"] >= rule.least, F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), F.lit(rank).alias("rank"), (a["at"] + x["gap"] + x["size"]).alias("end"), F.lit(rule.kind).alias("kind"))))).otherwise(a["out"]).alias("out"),
        ),
    )["out"]
    return F.when(F.size(hits) > 0, found).otherwise(none)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of docs with ``secret_spans``: array of (start, rank, end, kind) by start, then rule order."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    wanted = sorted({t for q in queries.values() if q is not None for a in q for t in a})
    keep = [c for c in docs.columns if c != "secret_spans"]
    docs = docs.select(*(F.col(f"`{c}`") for c in keep))
    may_, *own = fresh(docs, "may", "k1", "k2")
    rows = docs.select("*", *(k.alias(c) for k, c in zip(text_key(text), own, strict=True)))
    if wanted:
        may = cut(candidates(postings(docs, wanted, text), queries)).withColumnsRenamed(dict(zip(("k1", "k2", "may"), (*own, may_), strict=True)))
        rows = rows.join(may, own, "left")
    else:
        rows = rows.withColumn(may_, F.lit(None).cast("array<string>"))
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    each = []
    for rank, rule in enumerate(rules):
        pattern = F.lit(("(?i)" if rule.any_case else "") + rule.pattern)
        asked = F.array_contains(may_, rule.kind) if queries[rule.kind] is not None else F.regexp_like(t, pattern)
        each.append(F.when(asked, _spans(t, rule, rank)).otherwise(none))
    return rows.withColumn("secret_spans", F.array_sort(F.concat(*each))).select(*(F.col(f"`{c}`") for c in keep), "secret_spans")


def written(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(scanned: DataFrame, mark: str = "[SECRET]", text: str = "text") -> DataFrame:
    """Texts with every found span, overlapping spans as one, replaced by mark; secret_spans goes."""
    t = F.col(text)
    done = F.aggregate(
        "secret_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] >= a["at"], F.concat(a["out"], t.substr(a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(a["out"]).alias("out"),
        ),
    )
    clean = F.concat(done["out"], t.substr(done["at"] + 1, F.length(t)))
    return scanned.withColumn(text, F.when(F.size("secret_spans") > 0, clean).otherwise(t)).drop("secret_spans")


def digests(scanned: DataFrame, base: int = len(BASE)) -> DataFrame:
    """doc_id, spans of each base kind counted, the digest of base spans, and all spans."""
    own = F.filter("secret_spans", lambda s: s["rank"] < base)
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["rank"] == k)).cast("long")
    return scanned.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written(own), 256).alias("base_sha256"), written(F.col("secret_spans")).alias("spans"))
