"""Personal data in texts: candidates are runs of address characters, and each kind is validated, not only shaped.

One expression cuts a text into runs, in time linear in its length; everything else looks at
one run: card numbers by their check digit, identity numbers by check digit and date,
network addresses by their octets, coordinates by their range.

Defined cases: null texts hold nothing; a run counts without punctuation at its ends; a run is of the first kind that accepts it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = r"[A-Za-z0-9._%+@-]+"
EDGES = "._%+-"

#: Levels from low to high, the level of each kind, weights and check letters of identity numbers, words of addresses.
LEVELS = ["public", "internal", "confidential", "restricted", "secret"]
KIND_LEVELS = {"phone": "confidential", "id_card": "restricted", "email": "internal", "bank_card": "restricted", "address": "internal", "coordinate": "internal", "ip": "internal", "credential": "secret"}
ID_WEIGHTS = [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2]
ID_LETTERS = "10X98765432"
ADDRESS_WORDS = ["省", "市", "区", "县", "镇", "村", "路", "街", "号", "大道", "小区"]
CREDENTIAL = r"(?:[Pp]ass(?:word|wd)|[Ss]ecret|[Tt]oken|[Aa]pi_?[Kk]ey)[\"']? ?[:=]"


def _digit(v: Column, k: Column | int) -> Column:
    return F.substring(v, k, 1).try_cast("int")


def is_email(v: Column) -> Column:
    return F.rlike(v, F.lit(r"^[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+\.)+[A-Za-z]{2,}$"))


def is_phone(v: Column) -> Column:
    return F.rlike(v, F.lit(r"^(86)?1[3-9][0-9]{9}$"))


def is_id_card(v: Column) -> Column:
    """Seventeen digits with a possible date of birth, and the check letter that they ask for."""
    total = reduce(lambda a, b: a + b, (_digit(v, k + 1) * w for k, w in enumerate(ID_WEIGHTS)))
    check = F.substring(F.lit(ID_LETTERS), total % 11 + 1, F.lit(1)) == F.upper(F.substring(v, 18, 1))
    part = lambda at, n: F.substring(v, at, n).try_cast("int")
    return F.rlike(v, F.lit(r"^[0-9]{17}[0-9Xx]$")) & check & part(7, 4).between(1900, 2099) & part(11, 2).between(1, 12) & part(13, 2).between(1, 31)


def is_bank_card(v: Column) -> Column:
    """13 to 19 digits whose sum, every second from the right doubled (and 9 less if over 9), ends in 0."""

    def term(k: int) -> Column:
        d = F.coalesce(F.substring(F.reverse(v), k, 1).try_cast("int"), F.lit(0))
        return d if k % 2 else d * 2 - F.when(d > 4, 9).otherwise(0)

    return F.rlike(v, F.lit(r"^[0-9]{13,19}$")) & (reduce(lambda a, b: a + b, map(term, range(1, 20))) % 10 == 0)


def is_ip(v: Column) -> Column:
    octets = F.split(v, r"\.")
    return F.rlike(v, F.lit(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$")) & F.forall(octets, lambda o: o.try_cast("int") <= 255)


def is_coordinate(v: Column) -> Column:
    return F.rlike(v, F.lit(r"^[0-9]{1,3}\.[0-9]{4,}$")) & (v.try_cast("double") <= 180)


#: Kinds that single runs have, in the order in which they are asked.
KINDS: dict[str, Callable[[Column], Column]] = {"email": is_email, "phone": is_phone, "id_card": is_id_card, "bank_card": is_bank_card, "ip": is_ip, "coordinate": is_coordinate}


def runs(text: Column) -> Column:
    """The runs of a text that may be personal data: trimmed, of seven characters or more, with a digit or an @."""
    found = F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda v: F.trim(v, F.lit(EDGES)))
    return F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda v: (F.length(v) >= 7) & F.rlike(v, F.lit("[0-9@]")))


def kind_of(v: Column) -> Column:
    return reduce(lambda out, k: F.when(KINDS[k](v), k).otherwise(out), reversed(KINDS), F.lit(None).cast("string"))


def personal(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind, value, n: the validated personal data of each text and how often it occurs there."""
    each = df.select(key, F.explode(runs(F.col(text))).alias("value")).withColumn("kind", kind_of(F.col("value")))
    return each.where("kind IS NOT NULL").groupBy(key, "kind", "value").agg(F.count("*").alias("n")).select(key, "kind", "value", "n")


def redacted(text: Column) -> Column:
    """The text with each validated run replaced by its kind in brackets; all other characters stay."""
    between, found = F.split(text, RUN, -1), F.regexp_extract_all(text, F.lit(RUN), F.lit(0))

    def mark(v: Column) -> Column:
        core = F.trim(v, F.lit(EDGES))
        kind = F.when((F.length(core) >= 7) & F.rlike(core, F.lit("[0-9@]")), kind_of(core))
        whole = F.concat(F.regexp_extract(v, r"^[._%+-]*", 0), F.lit("["), F.upper(kind), F.lit("]"), F.regexp_extract(v, r"[._%+-]*$", 0))
        return F.coalesce(whole, v)

    return F.array_join(F.flatten(F.transform(F.arrays_zip(between.alias("gap"), F.transform(found, mark).alias("run")), lambda e: F.array(e["gap"], F.coalesce(e["run"], F.lit(""))))), "")


def sensitivity(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: how many of all its values hold each kind, and the highest level that they reach; one pass, nothing but counts is shuffled."""

    def held(c: str, kind: str) -> Column:
        text = F.col(c).cast("string")
        if kind == "address":
            return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in ADDRESS_WORDS))
        if kind == "credential":
            return F.rlike(text, F.lit(CREDENTIAL))
        return F.exists(F.col(f"_runs_{columns.index(c)}"), lambda v: kind_of(v).eqNullSafe(kind))

    cut = df.withColumns({f"_runs_{k}": runs(F.col(c).cast("string")) for k, c in enumerate(columns)})
    row = cut.agg(*(F.count_if(held(c, k)).alias(f"{n}|{k}") for n, c in enumerate(columns) for k in KIND_LEVELS))

    def one(n: int, c: str) -> Column:
        ranks = [F.when(F.col(f"`{n}|{k}`") > 0, LEVELS.index(v)).otherwise(0) for k, v in KIND_LEVELS.items()]
        return F.struct(F.lit(c).alias("column"), *(F.col(f"`{n}|{k}`").alias(k) for k in KIND_LEVELS), F.element_at(F.array(*map(F.lit, LEVELS)), F.greatest(*ranks) + 1).alias("level"))

    return row.select(F.explode(F.array(*(one(n, c) for n, c in enumerate(columns)))).alias("x")).select("x.*")
