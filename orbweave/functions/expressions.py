"""Column expressions: everything here stays inside whole-stage code generation."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0

#: Factors between area and length units.
UNITS = {
    ("m2", "ha"): 1e-4, ("ha", "m2"): 1e4, ("m2", "mu"): 1 / 666.67, ("mu", "m2"): 666.67,
    ("ha", "mu"): 15.0, ("mu", "ha"): 1 / 15.0, ("m", "km"): 1e-3, ("km", "m"): 1e3,
}


def fields(expression: str) -> str:
    """``!a! * 2`` as SQL: names between exclamation marks become quoted columns."""
    return re.sub(r"!([^!]+)!", lambda m: f"`{m[1]}`", expression)


def micros(c: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp with or without a time zone (the session's counts for the latter)."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres; null where a coordinate is (the least of 1 and a null would be half way round)."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Initial heading, degrees from north, 0 up to 360."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lng2 - lng1)
    y, x = F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def masked(c: Column, keep: int = 3, mark: str = "*") -> Column:
    """The first ``keep`` characters, marks for the rest; null stays null."""
    s = c.cast("string")
    return F.concat(F.substring(s, 1, keep), F.repeat(F.lit(mark), F.greatest(F.length(s) - keep, F.lit(0))))


def hashed(c: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(c.cast("string"), 256), 1, digits)


def redacted(c: Column) -> Column:
    return F.when(c.isNotNull(), F.lit("[REDACTED]"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null if either has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.try_divide(dot, norm(a) * norm(b))


def min_max(c: Column, low: Column, high: Column, invert: bool = False) -> Column:
    """(c - low) / (high - low) cut to 0..1; null where the range is empty."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(c - low, high - low)))
    return 1 - x if invert else x


def shape_index(area: Column, perimeter: Column) -> Column:
    return perimeter / (2 * F.sqrt(math.pi * area))


def cased(c: Column, rules: list[tuple[str, object]]) -> Column:
    """Inference rules in order, a later one that holds wins; conditions are SQL over the row."""
    return reduce(lambda old, r: F.when(F.expr(r[0]), F.lit(r[1])).otherwise(old), rules, c)


def coded(c: Column, mapping: dict[str, str], unmapped: str = "keep") -> Column:
    """A dictionary applied to c as text; what it lacks is kept, or null."""
    table = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    found = F.try_element_at(table, c.cast("string"))
    return F.coalesce(found, c.cast("string")) if unmapped == "keep" else found


def language(c: Column) -> Column:
    """ja with over 10 % kana, en with over 70 % Latin letters of the characters that are not white space, else zh."""
    n = F.length(F.regexp_replace(c, r"\s+", ""))
    kana, latin = F.regexp_count(c, F.lit(r"[぀-ヿ]")), F.regexp_count(c, F.lit("[A-Za-z]"))
    return F.when(kana > 0.1 * n, "ja").when(latin > 0.7 * n, "en").otherwise("zh")


def tokens(name: Column) -> Column:
    """Parts of a field name in snake, camel and digit style, lower-cased."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Za-z])([0-9])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), r"[^a-z0-9]+"), lambda x: x != "")


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies inside a ring of corners, by crossings; corners are a small literal."""
    crossings = []
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 == y2:
            continue
        at = (y - y1) * ((x2 - x1) / (y2 - y1)) + x1
        crossings.append(F.when(((y > y1) != (y > y2)) & (x < at), 1).otherwise(0))
    return reduce(lambda a, b: a + b, crossings) % 2 == 1
