"""Matching of field names in tiers, and of entity names that are nearly alike, by indexes of their parts instead of pairs."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.functions.expressions import jaccard, tokens
from orbweave.operators.graph import components
from orbweave.sources.io import materialized

#: Words that mean the same field, and what names of units look like.
SAME = [
    ["area", "面积", "zmj", "tbmj", "mj", "shape_area"],
    ["name", "名称", "mc", "dlmc", "qsdwmc", "dkmc"],
    ["code", "编码", "dm", "dlbm", "bm", "dkbm"],
    ["type", "类型", "lx", "dllx", "tdlylx"],
    ["slope", "坡度", "pd", "slope_deg"],
    ["id", "objectid", "fid", "gid", "pkid"],
    ["population", "人口", "rk", "rksl", "pop"],
    ["address", "地址", "dz", "addr", "location"],
    ["elevation", "高程", "dem", "gc", "alt", "height"],
    ["perimeter", "周长", "zc", "shape_length"],
]
UNITS = {"mu": ["亩", "mu"], "m2": ["平方米", "m2", "sqm", "square_m"], "ha": ["公顷", "ha", "hectare"], "m": ["米", "meter"], "km": ["千米", "公里", "km", "kilometer"]}
NUMBERS = ["int", "long", "short", "byte", "float", "double", "numeric", "decimal", "number"]
TEXTS = ["object", "str", "text", "char", "category"]
#: How sure each tier is, the least similarity of base names with units, of names by tokens, of entities.
EXACT, EQUIVALENT, UNIT_AWARE = 1.0, 0.8, 0.75
LEAST_BASE, LEAST_NAME, LEAST_ENTITY = 0.6, 0.65, 0.85


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters in matching blocks over the characters of both."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def similarity(a: str, b: str) -> Column:
    """0.6 of the tokens that two names share among all they have, and 0.4 of the ratio of their characters; 0 if one has no token."""
    x, y = tokens(F.col(a)), tokens(F.col(b))
    blend = 0.6 * jaccard(x, y) + 0.4 * ratio(F.lower(a), F.lower(b))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), blend).otherwise(0.0)


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def compatible(a: Column, b: Column) -> Column:
    """Whether two types may hold the same field: not one numbers and the other text."""
    a, b = F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit("")))
    return ~((_any(a, NUMBERS) & _any(b, TEXTS)) | (_any(a, TEXTS) & _any(b, NUMBERS)))


def unit(name: Column) -> Column:
    """The unit that a name speaks of, null if none: the first whose pattern it holds."""
    low, out = F.lower(name), F.lit(None).cast("string")
    for key, patterns in reversed(UNITS.items()):
        out = F.when(_any(low, patterns), key).otherwise(out)
    return out


def base(name: Column) -> Column:
    """The name without a unit at its end, lower-cased."""
    low = F.lower(name)
    out = low
    for p in reversed([p for patterns in UNITS.values() for p in patterns]):
        rest = F.regexp_replace(F.substring(low, F.lit(1), F.length(low) - len(p)), r"[_\- ]+$", "")
        out = F.when(F.endswith(low, F.lit(p)) & (rest != ""), rest).otherwise(out)
    return out


def assigned(pairs: DataFrame) -> DataFrame:
    """Of pairs (left, right, score) a one-to-one choice: pairs that are best for both sides, then those best among the rest, and so on.

    Ties go to the smaller name on either side, so the order of rows does not matter.
    """
    left_, done = materialized(pairs.select("left", "right", "score")), None
    while not left_.isEmpty():
        own = left_.groupBy("left").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("right").alias("r"))).alias("b")).select("left", F.col("b.r").alias("right"))
        to = left_.groupBy("right").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("left").alias("l"))).alias("b")).select("right", F.col("b.l").alias("left"))
        both = materialized(left_.join(own.join(to, ["left", "right"]), ["left", "right"]))
        done = both if done is None else done.unionAll(both.select(*done.columns))
        rest = left_.join(both.select("left"), "left", "left_anti").join(both.select("right"), "right", "left_anti")
        left_ = materialized(rest)
    return left_ if done is None else done


def match_fields(left: DataFrame, right: DataFrame, same: list[list[str]] | None = None) -> DataFrame:
    """left, right, confidence, kind of the fields (field, type) of two lists that mean the same; each field is in one match at most.

    Tiers, each for what those before left: equal but for case; words of one group of ``same``; other units of similar base
    names; names of at least three characters that share tokens, of compatible types. Within a tier the best pairs go first. A pair of the last tier
    shares a token, or it could not be similar enough, so tokens index it.
    """
    a = materialized(left.where("field IS NOT NULL").groupBy("field").agg(F.min("type").alias("type")).select(F.col("field").alias("left"), F.col("type").alias("left_type")))
    b = materialized(right.where("field IS NOT NULL").groupBy("field").agg(F.min("type").alias("type")).select(F.col("field").alias("right"), F.col("type").alias("right_type")))
    out = None

    def take(pairs: DataFrame, confidence: Column, kind: str) -> None:
        nonlocal a, b, out
        best = assigned(pairs).select("left", "right", confidence.alias("confidence"), F.lit(kind).alias("kind"))
        best = materialized(best)
        out = best if out is None else out.unionAll(best)
        a = materialized(a.join(best.select("left"), "left", "left_anti"))
        b = materialized(b.join(best.select("right"), "right", "left_anti"))

    take(a.withColumn("_k", F.lower("left")).join(b.withColumn("_k", F.lower("right")), "_k").withColumn("score", (F.col("left") == F.col("right")).cast("double")), F.lit(EXACT), "exact")
    words = a.sparkSession.createDataFrame([(w, k) for k, group in enumerate(same if same is not None else SAME) for w in group], "word string, grp int")
    named = lambda df, c: df.join(F.broadcast(words), F.lower(c) == F.col("word")).drop("word")  # noqa: E731  # a literal list
    take(named(a, "left").join(named(b, "right"), "grp").withColumn("score", F.lit(1.0)), F.lit(EQUIVALENT), "equivalent")

    def measured(df: DataFrame, c: str) -> DataFrame:
        own = df.withColumns({f"{c}_unit": unit(F.col(c)), f"{c}_base": base(F.col(c))}).where(F.col(f"{c}_unit").isNotNull())
        return own.withColumn("_c", F.explode(F.array_distinct(F.split(F.col(f"{c}_base"), ""))))

    close = measured(a, "left").join(measured(b, "right"), "_c").where("left_unit <> right_unit").drop("_c").distinct()
    take(close.withColumn("score", ratio("left_base", "right_base")).where(F.col("score") >= LEAST_BASE), F.lit(UNIT_AWARE), "unit_aware")
    long_ = lambda df, c: df.where(F.length(c) >= 3).withColumn("_t", F.explode(F.array_distinct(tokens(F.col(c)))))
    shared = long_(a, "left").join(long_(b, "right"), "_t").drop("_t").distinct().where(compatible(F.col("left_type"), F.col("right_type")))
    take(shared.withColumn("score", similarity("left", "right")).where(F.col("score") >= LEAST_NAME), F.round(0.5 + F.col("score") * 0.2, 2), "fuzzy")
    return out


def alike(names: DataFrame, least: float = LEAST_ENTITY) -> DataFrame:
    """a, b, score: pairs of distinct (name, type), a < b, of one type whose lower-cased names have a ratio of at least ``least`` (above 0.8).

    Unmatched characters part matching blocks, so such names share at least (3 * least / 2 - 1) * T - 1 of their bigrams (T characters
    in both), and one at least: a name enters the index with so many of its rarest bigrams that a partner must meet it there.
    """
    if least <= 0.8:
        raise ValueError("least must be above 0.8")
    n = materialized(names.where("name IS NOT NULL AND type IS NOT NULL").select(F.lower("name").alias("low"), "type").distinct())
    size = F.length("low")
    grams = n.where(size >= 2).withColumn("_k", F.explode(F.sequence(F.lit(1), size - 1))).select("low", "type", F.substring(F.col("low"), F.col("_k"), F.lit(2)).alias("gram"))
    # Equal bigrams of a name are told apart by number.
    grams = materialized(grams.groupBy("low", "type", "gram").agg(F.count("*").cast("int").alias("_n")).select("low", "type", "gram", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("no")))
    often = grams.groupBy("type", "gram", "no").agg(F.count("*").alias("freq"))
    rank = F.row_number().over(Window.partitionBy("low", "type").orderBy("freq", "gram", "no"))
    partner = size + F.ceil(size * (least / (2 - least)))  # the fewest characters that both can have
    need = F.greatest(F.lit(1), F.ceil((1.5 * least - 1) * partner - 1 - 1e-9))
    kept = materialized(grams.join(often, ["type", "gram", "no"]).withColumn("_r", rank).where(F.col("_r") <= size - 1 - need + 1).select("low", "type", "gram", "no"))
    a, b = kept.withColumnRenamed("low", "a"), kept.withColumnRenamed("low", "b")
    near = (F.length("b") <= F.length("a") * ((2 - least) / least) + 1e-9) & (F.length("a") <= F.length("b") * ((2 - least) / least) + 1e-9)
    pairs = a.join(b, ["type", "gram", "no"]).where((F.col("a") < F.col("b")) & near).select("type", "a", "b").distinct()
    return pairs.withColumn("score", ratio("a", "b")).where(F.col("score") >= least)


def merged_entities(entities: DataFrame, least: float = LEAST_ENTITY) -> DataFrame:
    """name, type, confidence, n of each cluster of entities (name, type, confidence) that are linked by nearly equal names of one type.

    The entity of highest confidence stays (ties to the smaller name); n counts the rows that it stands for. The order of rows does not matter.
    Null names or types are left out; repeated rows count.
    """
    there = materialized(entities.where("name IS NOT NULL AND type IS NOT NULL").withColumn("_id", F.to_json(F.array(F.lower("name"), F.col("type")))))
    links = alike(there, least)
    of = lambda c: F.to_json(F.array(F.col(c), F.col("type")))
    c = components(there.select(F.col("_id").alias("id")), links.select(of("a").alias("src"), of("b").alias("dst")))
    one = there.join(c.withColumnRenamed("id", "_id"), "_id").groupBy("component").agg(F.count("*").alias("n"), F.min(F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), "name", "type", "confidence")).alias("b"))
    return one.select("b.name", "b.type", "b.confidence", "n")
