"""Fields of tables: filters by map, typed defaults, dates in many formats, checks against a standard, conflicts between sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = {"TEXT": "string", "INTEGER": "long", "FLOAT": "float", "DOUBLE": "double"}

#: Formats that dates come in, tried in this order.
DATES = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd",
    "yyyy/MM/dd", "yyyyMMdd", "dd/MM/yyyy", "MM-dd-yyyy", "yyyy年MM月dd日",
)


def filter_map(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Rows whose columns hold the given texts, in any case; names that are no columns are passed over."""
    have = [F.contains(F.lower(F.col(f"`{c}`").cast("string")), F.lit(v.lower())) for c, v in wanted.items() if c in df.columns]
    return df.where(reduce(lambda a, b: a & b, have)) if have else df


def page(df: DataFrame, keys: list[str], offset: int, limit: int) -> DataFrame:
    """Rows offset to offset + limit (1 to 200) in the order of the keys, with the number of all rows."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*keys).offset(max(0, offset)).limit(max(1, min(200, limit)))
    return rows.crossJoin(F.broadcast(total))  # one row


def add_field(df: DataFrame, name: str, kind: str = "TEXT", default: object = None) -> DataFrame:
    return df.withColumn(name, F.lit(default).cast(TYPES[kind]))


def add_missing(df: DataFrame, standard: dict[str, str]) -> DataFrame:
    """The fields of a standard (name to Spark type) that df lacks: 0 for numbers, null for dates, else an empty text."""
    blank = {"string": F.lit(""), "date": F.lit(None), "timestamp": F.lit(None)}
    return df.select("*", *(blank.get(t, F.lit(0)).cast(t).alias(c) for c, t in standard.items() if c not in df.columns))


def stacked(frames: list[DataFrame]) -> DataFrame:
    """All rows by column name, missing columns as null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def parsed_date(c: Column) -> Column:
    """A timestamp from text in any of DATES, null where none fits; texts without a zone are in the session's."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(c), F.lit(f)) for f in DATES))


def merged_json(a: Column, b: Column) -> Column:
    """Two JSON objects of texts as one, b's values before a's; not deeper than one level."""
    as_map = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    one, two = as_map(a), as_map(b)
    rest = F.map_filter(one, lambda k, _: ~F.map_contains_key(two, k))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(rest, two)))))


def generalized(c: Column) -> Column:
    """Less exact: mobile numbers keep their first three and last four digits, addresses what leads to the first marker, others four characters."""
    s = c.cast("string")
    marks = [F.instr(s, m) for m in "区县镇村路街号"]
    at = F.coalesce(*(F.when(k > 1, k) for k in marks))
    phone = F.rlike(s, F.lit("^1.{10}$"))
    rest = F.when(F.length(s) > 4, F.concat(F.substring(s, 1, 4), F.lit("***"))).otherwise(s)
    return F.when(phone, F.concat(F.substring(s, 1, 3), F.lit("****"), F.substring(s, 8, 4))).when(at.isNotNull(), F.concat(s.substr(F.lit(1), at), F.lit("***"))).otherwise(rest)


def date_checks(df: DataFrame, date: str, low: str, high: str) -> DataFrame:
    """Rows without a date, before low, after high, and in between."""
    d = F.col(date)
    return df.agg(F.count("*").alias("n"), F.count_if(d.isNull()).alias("missing"), F.count_if(d < F.lit(low).cast("timestamp")).alias("expired"), F.count_if(d > F.lit(high).cast("timestamp")).alias("future"))


def standard_checks(df: DataFrame, standard: list[dict]) -> DataFrame:
    """One row per field of a standard (name, required, values, max_length): whether it is there, its faults, and the share of rows without one; one pass."""
    here = [f for f in standard if f["name"] in df.columns]
    aggs = [F.count("*").alias("_n")]
    for f in here:
        c = F.col(f"`{f['name']}`")
        aggs.append(F.count_if(c.isNull() if f.get("required") else F.lit(False)).alias(f"{f['name']}|nulls"))
        aggs.append(F.count_if(~c.cast("string").isin([str(v) for v in f["values"]]) if f.get("values") else F.lit(False)).alias(f"{f['name']}|codes"))
        aggs.append(F.count_if(F.length(c.cast("string")) > f["max_length"] if f.get("max_length") else F.lit(False)).alias(f"{f['name']}|long"))
    row = df.agg(*aggs)

    def one(f: dict) -> Column:
        there = f["name"] in df.columns
        got = [F.col(f"`{f['name']}|{k}`") if there else F.lit(None).cast("long") for k in ("nulls", "codes", "long")]
        share = 1 - F.try_divide(sum(got[1:], got[0]), F.col("_n")) if there else F.lit(0.0)
        return F.struct(F.lit(f["name"]).alias("field"), F.lit(there).alias("present"), *(g.alias(k) for g, k in zip(got, ("nulls", "codes", "too_long"), strict=True)), share.alias("compliance"))

    return row.select(F.explode(F.array(*map(one, standard))).alias("x")).select("x.*")


def schema_gaps(df: DataFrame, standard: dict[str, str]) -> DataFrame:
    """Every field of a standard and of df: present, missing or extra, whether types agree, and the share of rows with a value."""
    types = dict(df.dtypes)
    row = df.agg(F.count("*").alias("_n"), *(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns))
    each = [
        F.struct(
            F.lit(c).alias("field"), F.lit("missing" if c not in types else "present" if c in standard else "extra").alias("status"),
            F.lit(types[c] == standard[c] if c in types and c in standard else None).cast("boolean").alias("same_type"),
            (F.try_divide(F.col(f"`{c}`"), F.col("_n")) if c in types else F.lit(0.0)).cast("double").alias("filled"),
        )
        for c in [*standard, *(c for c in types if c not in standard)]
    ]
    return row.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def resolved(df: DataFrame, keys: list[str], value: str, source: str, time: str, how: str, order: list[str] | None = None) -> DataFrame:
    """One value per key where sources differ: by priority of sources, the latest, the most frequent (ties to the smaller), the mean, or the longest text."""
    v = F.col(value)
    there = df.where(v.isNotNull())
    if how == "voting":
        votes = there.groupBy(*keys, value).agg(F.count("*").alias("_k"))
        return votes.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_k"), v)).alias(value))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order or [""])), F.col(source)), F.lit(0))
    agg = {
        "priority": F.min_by(value, F.struct(F.when(rank > 0, rank).otherwise(len(order or []) + 1), F.col(source), v)),
        "latest": F.max_by(value, F.struct(F.col(time), v)),
        "mean": F.avg(v),
        "longest": F.max_by(value, F.struct(F.length(v.cast("string")), v)),
    }[how]
    return there.groupBy(*keys).agg(agg.alias(value))


def quality_level(confidence: Column) -> Column:
    return F.when(confidence < 0.3, "low").when(confidence < 0.7, "medium").otherwise("high")


def chunks(df: DataFrame, key: str, text: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """Pieces of at most ``size`` characters that repeat the last ``overlap`` of the piece before: key, chunk, start, piece; every character is in one."""
    step = size - overlap
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - overlap - 1) / step)).cast("int"))
    cut = df.where(n > 0).select(key, text, F.posexplode(F.transform(starts, lambda k: k * step)).alias("chunk", "start"))
    return cut.select(key, "chunk", "start", F.col(text).substr(F.col("start") + 1, F.lit(size)).alias("piece"))
