"""Filters, joins, aggregates, windows and set operations over tables of attributes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions.expressions import fields
from orbweave.operators.quantiles import quantiles
from orbweave.sources.io import materialized

STATS: dict[str, Callable[[str], Column]] = {
    "SUM": F.sum, "MEAN": F.avg, "MIN": F.min, "MAX": F.max, "COUNT": F.count, "STD": F.stddev_samp,
}
COMPARE: dict[str, Callable[[Column, object], Column]] = {
    ">": lambda c, v: c > float(v), "<": lambda c, v: c < float(v), ">=": lambda c, v: c >= float(v), "<=": lambda c, v: c <= float(v),
    "==": lambda c, v: c == v, "!=": lambda c, v: c != v,
}


def summary_statistics(df: DataFrame, stats: str, case: str | None = None, order: str | None = None) -> DataFrame:
    """``"f SUM;g MEAN"`` by case: columns f_SUM, g_MEAN. Rows with a null case are left out; without a case one row ``ALL``.

    FIRST and LAST need ``order``, since a distributed table has no order of its own.
    """
    aggs = []
    for part in filter(None, map(str.strip, stats.split(";"))):
        field, stat = part.split()
        stat = stat.upper()
        if stat in ("FIRST", "LAST"):
            if order is None:
                raise ValueError(f"{stat} needs an ordering column")
            one = (F.min_by if stat == "FIRST" else F.max_by)(field, order)
        else:
            one = STATS[stat](field)
        aggs.append(one.alias(f"{field}_{stat}"))
    if case is None:
        return df.agg(*aggs).select(F.lit("ALL").alias("case"), "*")
    return df.where(F.col(case).isNotNull()).groupBy(case).agg(*aggs)


def filter_rows(df: DataFrame, column: str, op: str, value: object) -> DataFrame:
    """One comparison; range operators take the value as a number, a column that is not there changes nothing."""
    return df.where(COMPARE[op](F.col(column), value)) if column in df.columns else df


def transform(df: DataFrame, steps: list[dict]) -> DataFrame:
    """An ordered list of steps {op: filter | select | rename | calculate, ...} as one lazy plan."""
    done = {
        "filter": lambda d, s: filter_rows(d, s["column"], s["operator"], s["value"]),
        "select": lambda d, s: d.select(*dict.fromkeys(c for c in s["columns"] if c in d.columns)),
        "rename": lambda d, s: d.withColumnsRenamed(s["mapping"]),
        "calculate": lambda d, s: d.withColumn(s["name"], F.expr(fields(s["expression"]))),
    }
    return reduce(lambda d, s: done[s["op"]](d, s), steps, df)


def attribute_join(left: DataFrame, right: DataFrame, on: str, right_on: str | None = None, suffix: str = "_join") -> DataFrame:
    """Left join in which null keys meet null keys; the right side's clashing columns take a suffix."""
    right_on = right_on or on
    names = {c: f"{c}{suffix}" for c in right.columns if c in left.columns}
    right = right.withColumnsRenamed(names)
    key = names.get(right_on, right_on)
    out = left.join(right, F.col(on).eqNullSafe(F.col(key)), "left")
    return out.drop(key) if right_on == on else out


def join_key(left: DataFrame, right: DataFrame) -> str | None:
    """The first common column, ignoring case; columns that look like ids first."""
    held = {c.lower() for c in right.columns}
    common = [c for c in left.columns if c.lower() in held]
    ids = [c for c in common if any(x in c.lower() for x in ("id", "key", "code", "bm", "dm"))]
    return next(iter([*ids, *common]), None)


def latest(df: DataFrame, keys: list[str], order: str, *ties: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order), *(F.desc(t) for t in ties))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Every row whose columns occur more than once, with how often: counted per value, then joined, so that hot values stay cheap."""
    often = df.groupBy(*columns).agg(F.count("*").alias("copies")).where("copies > 1")
    return df.join(often, columns)


def forward_fill(df: DataFrame, column: str, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def cast_field(df: DataFrame, column: str, to: str) -> DataFrame:
    """Values that do not cast become null; fractional values are no integers."""
    kind = {"string": "string", "integer": "bigint", "float": "double", "date": "timestamp"}[to]
    c = F.col(column)
    new = c.try_cast(kind)
    if to == "integer":
        new = F.when(c.try_cast("double") == new, new)
    return df.withColumn(column, new)


def cast_failures(df: DataFrame, column: str, to: str) -> DataFrame:
    return cast_field(df.withColumn("_was", F.col(column)), column, to).agg(F.count_if(F.col("_was").isNotNull() & F.col(column).isNull()).alias("failures"))


def fill_nulls(df: DataFrame, column: str, how: str, default: object = None) -> DataFrame:
    """default, mean, median or mode (the smallest of the most frequent); one row of statistics is joined, nothing is collected."""
    if how == "default":
        return df.withColumn(column, F.coalesce(column, F.lit(default)))
    if how == "mode":
        stat = df.where(F.col(column).isNotNull()).groupBy(column).count().agg(F.min_by(column, F.struct(-F.col("count"), F.col(column))).alias("_s"))
    else:
        stat = df.agg(F.avg(column).alias("_s")) if how == "mean" else quantiles(df, column, [0.5]).select(F.col("q")[0].alias("_s"))
    return df.crossJoin(F.broadcast(stat)).withColumn(column, F.coalesce(column, "_s")).drop("_s")  # one row


def clip_outliers(df: DataFrame, column: str, lower: float, upper: float, strategy: str = "clip") -> DataFrame:
    c = F.col(column)
    if strategy == "remove":
        return df.where(c.isNull() | c.between(lower, upper))
    inside = F.greatest(F.lit(lower), F.least(F.lit(upper), c)) if strategy == "clip" else F.when(c.between(lower, upper), c)
    return df.withColumn(column, F.when(c.isNotNull(), inside))


def classify_changes(before: DataFrame, after: DataFrame, key: str, attributes: list[str], threshold: float = 0.01) -> DataFrame:
    """key and change: added, removed, modified (a relative change above threshold), unchanged."""
    a = before.select(key, F.lit(True).alias("_a"), *(F.col(c).alias(f"{c}_1") for c in attributes))
    b = after.select(key, F.lit(True).alias("_b"), *(F.col(c).alias(f"{c}_2") for c in attributes))
    moved = lambda c: F.when(F.col(f"{c}_1") == 0, F.col(f"{c}_2") != 0).otherwise(F.abs(F.col(f"{c}_2") - F.col(f"{c}_1")) / F.abs(F.col(f"{c}_1")) > threshold)
    changed = reduce(lambda x, y: x | y, (F.coalesce(moved(c), ~F.col(f"{c}_1").eqNullSafe(F.col(f"{c}_2"))) for c in attributes))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(changed, "modified").otherwise("unchanged")
    return a.join(b, key, "full").select(key, kind.alias("change"))


def dataset_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts: rows of both, and how many rows each has that the other lacks."""
    columns = [c for c in old.columns if c in new.columns]
    a, b = old.select(*columns), new.select(*columns)
    one = lambda d, name: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return reduce(DataFrame.unionAll, [one(a, "old"), one(b, "new"), one(a.exceptAll(b), "removed"), one(b.exceptAll(a), "added")])


def skyline(df: DataFrame, key: str, maximise: list[str], minimise: list[str], sample: int = 256, block: int = 4096) -> DataFrame:
    """The rows that no other row beats in every goal; rows of equal goals stay together, rows with a null goal go.

    Distinct goals that one of ``sample`` strong ones beats go first. Up to ``block`` that are left meet at once; more are dealt by their
    order, go against their own block and then, as what beats a row comes after it in that order, against the blocks behind. A task
    compares two blocks at most; the whole is the square of the front.
    """
    names = [f"_g{i}" for i in range(len(maximise) + len(minimise))]
    goals = dict(zip(names, [*(F.col(c) for c in maximise), *(-F.col(c) for c in minimise)]))
    rows = df.withColumns(goals).dropna(subset=names)
    vectors = rows.select(*names).distinct()
    ends = vectors.agg(*(f(F.col(c).cast("double")) for c in names for f in (F.min, F.max))).first()  # one row
    parts = [(F.col(c) - lo) / (hi - lo) for c, lo, hi in zip(names, ends[::2], ends[1::2]) if lo is not None and lo < hi]
    strong = vectors.orderBy(F.desc(reduce(lambda a, b: a + b, parts, F.lit(0.0))), *names).limit(sample)

    def beats(by: str = "r") -> Column:
        ge = reduce(lambda a, b: a & b, (F.col(f"{by}{c}") >= F.col(c) for c in names))
        return ge & reduce(lambda a, b: a | b, (F.col(f"{by}{c}") > F.col(c) for c in names))

    def renamed(d: DataFrame, *more: Column) -> DataFrame:
        return d.select(*(F.col(c).alias(f"r{c}") for c in names), *more)

    front = materialized(vectors.join(F.broadcast(renamed(strong)), beats(), "left_anti"))
    n = front.count()
    if n <= block:
        best = front.join(F.broadcast(renamed(front)), beats(), "left_anti")
    else:
        dealt = materialized(front.repartitionByRange(-(-n // block), *names).withColumn("_i", F.spark_partition_id()))
        local = materialized(dealt.join(renamed(dealt, F.col("_i").alias("r_i")), (F.col("_i") == F.col("r_i")) & beats(), "left_anti"))
        last = local.agg(F.max("_i")).first()[0]
        behind = local.where(F.col("_i") < last).withColumn("_j", F.explode(F.sequence(F.col("_i") + 1, F.lit(last))))
        before = renamed(local.where("_i > 0"), F.col("_i").alias("r_j"), F.explode(F.sequence(F.lit(0), F.col("_i") - 1)).alias("r_i"))
        beaten = behind.join(before, (F.col("_i") == F.col("r_i")) & (F.col("_j") == F.col("r_j")) & beats(), "left_semi").select(*names).distinct()
        best = local.join(beaten, names, "left_anti")
    held = renamed(best)
    return rows.join(held, reduce(lambda a, b: a & b, (F.col(c) == F.col(f"r{c}") for c in names)), "left_semi").drop(*names)


def id_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of distinct ids: both, left or right; null ids are none."""
    a, b = (d.select(key).where(F.col(key).isNotNull()).distinct().withColumn(s, F.lit(True)) for d, s in ((left, "_l"), (right, "_r")))
    return a.join(b, key, "full").select(key, F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both").alias("side"))
