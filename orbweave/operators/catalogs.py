"""Catalogs of data: who may see what, search by words, codes, tags, versions, entities in texts, and scores of quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.operators.quantiles import quantiles
from orbweave.sources.io import materialized


def visible(df: DataFrame, owner: str, shared: str, user: str, admin: bool = False) -> DataFrame:
    """Rows that a user owns or that are shared; an administrator sees all."""
    return df if admin else df.where((F.col(owner) == user) | F.coalesce(F.col(shared).cast("boolean"), F.lit(False)))


def under(df: DataFrame, column: str, prefixes: list[str]) -> DataFrame:
    """Rows whose code lies under any of the prefixes of a hierarchy."""
    return df.where(reduce(lambda a, b: a | b, (F.startswith(F.col(column), F.lit(p)) for p in prefixes), F.lit(False)))


#: Roots that go to every task; more meet the codes by a shuffle.
ROOTS = 100_000


def expanded(terms: DataFrame, tree: DataFrame, term: str, name: str, code: str) -> DataFrame:
    """Each term with the codes of the tree's rows of that name and with all codes that begin with one of them, each once.

    Prefixes meet codes by equality: a code is entered once for each of its own prefixes. Codes are dealt by value first, so a
    task enters, and keeps apart, its share alone.
    """
    roots = terms.select(term).distinct().join(tree.select(F.col(name).alias(term), F.col(code).alias("_root")), term)
    roots = materialized(roots.where(F.length("_root") > 0).distinct())
    roots = F.broadcast(roots) if roots.count() <= ROOTS else roots
    prefixes = F.explode(F.transform(F.sequence(F.lit(1), F.length(code)), lambda n: F.substring(F.col(code), F.lit(1), n)))
    dealt = tree.where(F.length(code) > 0).select(code).repartition(int(tree.sparkSession.conf.get("spark.sql.shuffle.partitions")), code)
    return dealt.select(F.col(code), prefixes.alias("_root")).join(roots, "_root").select(term, code).distinct()


def grams(c: Column, n: int = 2) -> Column:
    """Distinct runs of n characters of the lower-cased text without white space; a shorter text is one run."""
    s = F.regexp_replace(F.lower(c), r"\s+", "")
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))), lambda k: F.substring(s, k, F.lit(n)))
    return F.when(F.length(s) > 0, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def lexical_score(c: Column, query: str) -> Column:
    """0.9 where the text holds the query, else 0.85 times the share of the query's two-character runs that it holds; null texts 0."""
    wanted = F.array_distinct(F.split(F.trim(F.lower(F.lit(query))), r"\s+"))
    runs = F.array_distinct(F.flatten(F.transform(wanted, lambda w: grams(w))))
    share = F.try_divide(F.size(F.filter(runs, lambda g: F.contains(F.lower(c), g))), F.size(runs))
    return F.coalesce(F.when(F.contains(F.lower(c), F.lit(query.lower())), F.lit(0.9)).otherwise(0.85 * share), F.lit(0.0))


def search(df: DataFrame, key: str, text: str, query: str, k: int = 20, least: float = 0.3) -> DataFrame:
    """The k rows that fit a query best, from a score of ``least``, ties to the smaller key."""
    return df.select(key, lexical_score(F.col(text), query).alias("score")).where(F.col("score") >= least).orderBy(F.desc("score"), key).limit(k)


def alias_score(c: Column, aliases: list[str]) -> Column:
    """1 where a text is an alias, 0.7 where it holds one, else 0.6 times the closeness of the nearest by edits; case is ignored."""
    s = F.lower(F.trim(c))
    each = []
    for a in (x.lower() for x in aliases):
        near = 1 - F.try_divide(F.levenshtein(s, F.lit(a)), F.greatest(F.length(s), F.lit(len(a))))
        each.append(F.when(s == a, 1.0).when(F.contains(s, F.lit(a)), 0.7).otherwise(0.6 * near))
    return F.greatest(*each, F.lit(0.0))


def tagged(df: DataFrame, column: str, tags: list[str]) -> DataFrame:
    """Rows whose array holds every tag."""
    return df.where(F.size(F.array_except(F.array(*map(F.lit, tags)), F.col(column))) == 0) if tags else df


#: Codes for kinds of data.
KINDS = {"vector": "VEC", "raster": "RAS", "tabular": "TAB", "other": "OTH"}


def asset_code(key: Column, kind: Column, owner: Column, year: Column) -> Column:
    """DA-kind-owner-year-number, the number in at least four hexadecimal digits."""
    code = reduce(lambda a, kv: F.when(F.lower(kind) == kv[0], kv[1]).otherwise(a), KINDS.items(), F.lit("OTH"))
    digits = F.hex(key.cast("long"))
    digits = F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)
    return F.concat_ws("-", F.lit("DA"), code, F.upper(F.coalesce(F.nullif(F.substring(owner, 1, 3), F.lit("")), F.lit("UNK"))), year.cast("string"), digits)


def parsed_code(code: Column) -> Column:
    """kind, owner, year and number of an asset code as a struct, null where the form is another."""
    form = r"^DA-([A-Z]{3})-([^-]{1,3})-([0-9]{4})-([0-9A-F]{4,})$"
    part = lambda k: F.regexp_extract(code, form, k)
    return F.when(F.rlike(code, F.lit(form)), F.struct(part(1).alias("kind"), part(2).alias("owner"), part(3).cast("int").alias("year"), F.conv(part(4), 16, 10).cast("long").alias("number")))


def entities(df: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """(key, name, type): what the patterns (type -> expression) find in whole texts, each name once a row, of the first pattern that finds it."""
    kinds = list(patterns)

    def hits(k: int, p: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)), lambda m: F.struct(F.trim(m).alias("name"), F.lit(k).alias("_k")))

    found = F.concat(*(hits(k, p) for k, p in enumerate(patterns.values())))
    each = df.where(F.col(text).isNotNull()).select(key, F.explode(F.array_distinct(found)).alias("e")).where("e.name <> ''")
    first = each.groupBy(key, F.col("e.name").alias("name")).agg(F.min("e._k").alias("_k"))
    return first.select(key, "name", F.element_at(F.array(*map(F.lit, kinds)), F.col("_k") + 1).alias("type"))


def next_versions(new: DataFrame, old: DataFrame, key: str, version: str, order: str) -> DataFrame:
    """New rows numbered on from the highest version that their key has."""
    last = old.groupBy(key).agg(F.max(version).alias("_last"))
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return new.withColumn("_n", n).join(last, key, "left").withColumn(version, (F.coalesce("_last", F.lit(0)) + F.col("_n")).cast("long")).drop("_n", "_last")


def insert_new(old: DataFrame, new: DataFrame, content: str, key: str) -> DataFrame:
    """New rows whose content's hash is not among the old ones, one of each (the least key); with the hash."""
    h = F.sha2(F.col(content), 256).alias("hash")
    fresh = new.select("*", h).where("hash IS NOT NULL").join(old.select(h), "hash", "left_anti")
    first = fresh.groupBy("hash").agg(F.min(key).alias(key))
    return fresh.join(first, ["hash", key]).dropDuplicates(["hash"])


#: Names of files' kinds by extension.
EXTENSIONS = {"vector": ["shp", "geojson", "gpkg", "kml", "kmz"], "raster": ["tif", "tiff", "img"], "tabular": ["csv", "xlsx", "xls", "parquet"]}


def asset_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return reduce(lambda a, kv: F.when(ext.isin(kv[1]), kv[0]).otherwise(a), EXTENSIONS.items(), F.lit("other"))


def metadata_score(crs: Column, columns: Column, extent: Column) -> Column:
    """0.5, with 0.2 for a reference system and 0.15 each for columns and an extent."""
    has = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    return F.lit(0.5) + has(crs, 0.2) + has(columns, 0.15) + has(extent, 0.15)


#: Weights of the parts of a governance score.
PARTS = {"topology": 0.25, "gaps": 0.15, "completeness": 0.20, "validity": 0.15, "duplicates": 0.10, "crs": 0.15}


def governance(df: DataFrame) -> DataFrame:
    """Rows of audits (overlaps, gap_count, complete_percent, valid_share, duplicate_count, crs_ok) with their total of weighted parts and grade A to F."""
    part = {
        "topology": F.when(F.col("overlaps") == 0, 100).when(F.col("overlaps") < 5, 50).otherwise(0), "gaps": F.greatest(F.lit(0), 100 - F.col("gap_count") * 10), "completeness": F.col("complete_percent"),
        "validity": F.col("valid_share") * 100, "duplicates": F.greatest(F.lit(0), 100 - F.col("duplicate_count") * 5), "crs": F.when(F.col("crs_ok"), 100).otherwise(0),
    }
    total = F.round(reduce(lambda a, b: a + b, (F.coalesce(part[k], F.lit(0)) * w for k, w in PARTS.items())), 2)
    t = F.col("total")
    return df.withColumn("total", total).withColumn("grade", F.when(t >= 90, "A").when(t >= 80, "B").when(t >= 60, "C").when(t >= 40, "D").otherwise("F"))


def names(df: DataFrame, names: list[str], longest: int = 30) -> DataFrame:
    """Field names that hold other characters than letters, digits, underscores and CJK, begin with a digit, or are too long; df lends its session."""
    n = df.sparkSession.createDataFrame([(x,) for x in names], "field string")
    odd = ~F.rlike("field", F.lit(r"^[A-Za-z_一-鿿][A-Za-z0-9_一-鿿]*$"))
    issues = F.array_compact(F.array(F.when(odd, "characters"), F.when(F.length("field") > longest, "length")))
    return n.select("field", F.explode(issues).alias("issue"))


def confidence(df: DataFrame, sources: dict[str, dict[str, float]], conflicting: Column) -> DataFrame:
    """Each row with the mean of its sources' 0.4 timeliness + 0.3 precision + 0.3 completeness (0.8 where unknown), 0.3 less (at least 0.1) where sources conflict."""
    each = [0.4 * m.get("timeliness", 0.8) + 0.3 * m.get("precision", 0.8) + 0.3 * m.get("completeness", 0.8) for m in sources.values()]
    base = sum(each) / len(each) if each else 0.8
    return df.withColumn("confidence", F.when(F.coalesce(conflicting, F.lit(False)), max(0.1, base - 0.3)).otherwise(base))


def provenance(df: DataFrame, value: str, sources: list[str], to: str) -> DataFrame:
    """The first source column whose text equals the resolved value, else the first source."""
    found = F.coalesce(*(F.when(F.col(c).cast("string") == F.col(value).cast("string"), c) for c in sources), F.lit(sources[0]))
    return df.withColumn(to, found)


def metrics(df: DataFrame, by: list[str], definitions: dict[str, str]) -> DataFrame:
    """Named metrics, each an aggregate in SQL, per group."""
    return df.groupBy(*by).agg(*(F.expr(x).alias(n) for n, x in definitions.items()))


#: Fields that follow from others; a target that is there is kept.
DERIVED = {
    "height": (["floors"], "floors * 3.0"),
    "population_density": (["population", "area"], "try_divide(population, area / 1000000.0)"),
    "compactness": (["area", "perimeter"], "try_divide(4 * pi() * area, perimeter * perimeter)"),
    "shape_index": (["area", "perimeter"], "try_divide(perimeter, 2 * sqrt(pi() * area))"),
}


def derive(df: DataFrame) -> DataFrame:
    """All of DERIVED whose fields are there and whose target is not."""
    return df.withColumns({to: F.expr(x) for to, (need, x) in DERIVED.items() if to not in df.columns and set(need) <= set(df.columns)})


def rules(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    """One row per rule (SQL that holds for a good row): rows that break it and the share that passes; null breaks none. One pass."""
    row = df.agg(F.count("*").alias("_n"), *(F.count_if(~F.expr(x)).alias(k) for k, x in checks.items()))
    each = F.array(*(F.struct(F.lit(k).alias("rule"), F.col(f"`{k}`").alias("failures"), (1 - F.try_divide(F.col(f"`{k}`"), F.col("_n"))).alias("pass_share")) for k in checks))
    return row.select(F.explode(each).alias("x")).select("x.*")


def nearest_per(df: DataFrame, by: list[str], distance: Column, key: str) -> DataFrame:
    """Of each group the row at the least distance, ties to the smaller key; nulls last."""
    return df.groupBy(*by).agg(F.min_by(F.struct(*(c for c in df.columns if c not in by)), F.struct(distance.isNull(), distance, F.col(key))).alias("_r")).select(*by, "_r.*")


def tabulate(df: DataFrame, zone: str, kind: str, kinds: list, amount: str) -> DataFrame:
    """Zones by classes: sums of an amount, 0 where a zone has none of a class; kinds are given, so one pass does it."""
    return df.groupBy(zone).agg(*(F.coalesce(F.sum(F.when(F.col(kind) == k, F.col(amount))), F.lit(0.0)).alias(f"{kind}_{k}") for k in kinds))


def distance_summary(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cosine distances of two vector columns: mean, largest, median, 95 % and deviation over all rows."""
    from orbweave.functions.expressions import cosine

    d = materialized(pairs.select((1 - cosine(F.col(a), F.col(b))).alias("d")))
    one = d.agg(F.avg("d").alias("mean"), F.max("d").alias("largest"), F.stddev_pop("d").alias("sd")).crossJoin(F.broadcast(quantiles(d, "d", [0.5, 0.95])))  # single rows
    return one.select("mean", "largest", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), "sd")


def matched_effect(df: DataFrame, key: str, treatment: str, score: str, outcome: str, caliper: float | None = None) -> DataFrame:
    """Effect on the treated from pairs of each treated row with the other row of nearest score (with replacement): pairs, effect, standard error, 95 % interval.

    Distinct scores of both are dealt by range and sorted there once, so scores that crowd are many tasks, and the nearest on
    either side is carried over a range's end by each range's first and last score; rows at one score stand for
    each other by the least key, so a hot score is one row. Two neighbours equally near: the lower score. Without
    untreated rows there are no pairs.
    """
    s = F.col(score)
    there = df.where(s.isNotNull() & F.col(outcome).isNotNull())
    others = there.where(F.col(treatment) == 0).groupBy(score).agg(F.min_by(outcome, key).alias("_y"))
    others = others.select(s.alias("_s"), F.struct(s.alias("s"), F.col("_y").alias("y")).alias("_c"))
    treated = there.where(F.col(treatment) == 1).groupBy(score).agg(F.count("*").alias("_n"), F.sum(outcome).alias("_t"), F.sum(F.col(outcome) * F.col(outcome)).alias("_t2"))
    treated = treated.select(s.alias("_s"), "_n", "_t", "_t2")
    both = materialized(treated.unionByName(others, allowMissingColumns=True).repartitionByRange("_s").withColumn("_b", F.spark_partition_id()))
    ends = both.groupBy("_b").agg(F.min("_c").alias("_first"), F.max("_c").alias("_last"))  # a row for each range
    whole = Window.orderBy("_b")
    ends = ends.select("_b", F.last("_last", True).over(whole.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_first", True).over(whole.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    w = Window.partitionBy("_b").orderBy("_s")
    near = both.withColumns({"_lo": F.last("_c", True).over(w.rangeBetween(Window.unboundedPreceding, 0)), "_hi": F.first("_c", True).over(w.rangeBetween(0, Window.unboundedFollowing))}).where("_n IS NOT NULL")
    near = near.join(ends, "_b").withColumns({"_lo": F.coalesce("_lo", "_before"), "_hi": F.coalesce("_hi", "_after")})
    up, down = F.col("_hi.s") - F.col("_s"), F.col("_s") - F.col("_lo.s")
    c = F.when(F.col("_hi").isNull() | (down <= up), F.col("_lo")).otherwise(F.col("_hi"))
    pairs = near.withColumn("_c", c).where("_c IS NOT NULL")
    if caliper is not None:
        pairs = pairs.where(F.abs(F.col("_c.s") - F.col("_s")) < caliper)
    # Per score: n treated outcomes y with one match m give n differences, of sum t - n m and squares t2 - 2 m t + n m^2.
    y = F.col("_c.y")
    m = pairs.agg(F.sum("_n").alias("pairs"), F.sum(F.col("_t") - F.col("_n") * y).alias("_d"), F.sum(F.col("_t2") - 2 * y * F.col("_t") + F.col("_n") * y * y).alias("_d2"))
    effect = F.try_divide(F.col("_d"), F.col("pairs"))
    spread = F.try_divide(F.col("_d2") - F.col("_d") * effect, F.col("pairs") - 1)
    m = m.select("pairs", effect.alias("effect"), F.sqrt(F.try_divide(F.greatest(spread, F.lit(0.0)), F.col("pairs"))).alias("se"))
    return m.select("*", (F.col("effect") - 1.96 * F.col("se")).alias("low"), (F.col("effect") + 1.96 * F.col("se")).alias("high"))
