"""Quality of a fused table: ten checks, each one row with its finding and what it takes from the score."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.operators.quantiles import quantiles
from orbweave.operators.spatial import ring_area

#: Shares from which a finding counts, and its weight.
MANY_NULLS, SOME_NULLS = (0.5, 0.1), (0.2, 0.05)
FEW_ROWS, FAR_OUT, SLIVERS = (0.5, 0.15), (0.05, 0.05), (0.1, 0.05)
INVALID, CROSSED, SHIFTED = 0.15, 0.1, 0.05
FENCE, LEAST_VALUES, SLIVER_OF_MEDIAN, KOLMOGOROV = 5, 5, 0.001, 1.63

_ROWS = "check string, column string, value double, penalty double"


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def crosses_itself(ring: str) -> Column:
    """Whether two edges of a ring that are no neighbours cross or touch; the work is the square of a ring's corners."""
    r, n = F.col(ring), F.size(ring)
    edge = lambda k: (r[k], r[(k + 1) % n])
    turn = lambda a, b, c: F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))
    within = lambda a, b, c: c["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & c["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    def meet(i: Column, j: Column) -> Column:
        (a, b), (c, d) = edge(i), edge(j)
        t = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
        touch = ((t[0] == 0) & within(a, b, c)) | ((t[1] == 0) & within(a, b, d)) | ((t[2] == 0) & within(c, d, a)) | ((t[3] == 0) & within(c, d, b))
        return ((t[0] * t[1] < 0) & (t[2] * t[3] < 0)) | touch

    far = lambda i: F.filter(F.sequence(F.lit(0), n - 1), lambda j: (j > i + 1) & ~((i == 0) & (j == n - 1)))
    return F.coalesce((n >= 4) & F.exists(F.sequence(F.lit(0), n - 1), lambda i: F.exists(far(i), lambda j: meet(i, j))), F.lit(False))


def checks(df: DataFrame, sources: list[DataFrame] | None = None, ring: str | None = None, crs: str | None = None, source_crs: list[str] | None = None) -> DataFrame:
    """check, column, value, penalty of every finding over all rows and columns.

    empty, null_rate (of each column), row_completeness and column_completeness (against the largest source), outliers (share of each
    numeric column's values beyond five interquartile ranges), invalid_geometry and crossed_geometry, micro_polygons (below a
    thousandth of the median area), crs_changed, and distribution_shift (largest difference of the distributions of a numeric column and the same
    column of the first source that has it, seen at the source's hundred quantiles; tested at 1 %).
    """
    spark, columns = df.sparkSession, [c for c in df.columns if c != ring]
    numbers = [c for c in _numeric(df) if c != ring]
    found: list[tuple[str, str | None, float, float]] = []
    null = {c: F.avg(F.col(c).isNull().cast("int")).alias(f"n{k}") for k, c in enumerate(columns)}
    shape = []
    if ring is not None:
        there = F.col(ring).isNotNull()
        bad = (F.size(ring) < 3) | (ring_area(ring) == 0)
        shape = [F.count_if(there).alias("rings"), F.count_if(there & (bad | crosses_itself(ring))).alias("bad"), F.count_if(there & crosses_itself(ring)).alias("crossed")]
    row = df.agg(F.count("*").alias("rows"), *null.values(), *shape).first()  # one row
    n = row["rows"]
    if not n:
        return spark.createDataFrame([("empty", None, 1.0, 1.0)], _ROWS)
    for k, c in enumerate(columns):
        share = row[f"n{k}"]
        found.append(("null_rate", c, share, MANY_NULLS[1] if share > MANY_NULLS[0] else SOME_NULLS[1] if share > SOME_NULLS[0] else 0.0))
    if sources:
        most = max(s.count() for s in sources)
        if most:
            found.append(("row_completeness", None, n / most, FEW_ROWS[1] if n / most < FEW_ROWS[0] else 0.0))
        found.append(("column_completeness", None, min(1.0, len(columns) / (max(len(s.columns) for s in sources) + 1)), 0.0))
    out = []
    for c in numbers:
        q = quantiles(df, c, [0.25, 0.75]).first()["q"]
        if q is None or q[0] is None or q[1] <= q[0]:
            continue
        reach = FENCE * (q[1] - q[0])
        got = df.agg(F.count(c).alias("n"), F.count_if((F.col(c) < q[0] - reach) | (F.col(c) > q[1] + reach)).alias("far")).first()
        if got["n"] >= LEAST_VALUES:
            out.append((c, got["far"] / got["n"]))
    hit = [c for c, s in out if s > FAR_OUT[0]]
    found += [("outliers", c, s, FAR_OUT[1] if hit and c == hit[0] else 0.0) for c, s in out]  # counts once
    if ring is not None and row["rings"]:
        found.append(("invalid_geometry", None, row["bad"] / n, INVALID if row["bad"] else 0.0))
        found.append(("crossed_geometry", None, row["crossed"] / n, CROSSED if row["crossed"] else 0.0))
        areas = df.where(F.col(ring).isNotNull()).select(F.abs(ring_area(ring)).alias("a"))
        middle = quantiles(areas, "a", [0.5]).first()["q"][0]
        tiny = areas.agg(F.count_if(F.col("a") < middle * SLIVER_OF_MEDIAN).alias("t")).first()["t"] / n if middle else 0.0
        found.append(("micro_polygons", None, tiny, SLIVERS[1] if tiny > SLIVERS[0] else 0.0))
    if crs is not None and source_crs:
        found.append(("crs_changed", None, float(crs not in source_crs), 0.0))
    shifts = [(c, *_shift(df, next(s for s in sources if c in _numeric(s)), c)) for c in numbers if sources and any(c in _numeric(s) for s in sources)]
    moved = [c for c, _, far in shifts if far]
    counts = len(numbers) > 2 and len(moved) > len(numbers) / 2
    found += [("distribution_shift", c, d, SHIFTED if counts and c == moved[0] else 0.0) for c, d, _ in shifts]
    return spark.createDataFrame([(a, b, float(v), float(p)) for a, b, v, p in found], _ROWS)


def _shift(df: DataFrame, source: DataFrame, column: str) -> tuple[float, bool]:
    """The largest difference of two distributions at the source's quantiles, and whether it is beyond chance."""
    edges = [e for e in quantiles(source, column, [k / 100 for k in range(101)], nearest_rank=True).first()["q"] if e is not None]
    if not edges:
        return 0.0, False
    edges = sorted(set(edges))
    share = [F.count_if(F.col(column) <= e).alias(f"e{k}") for k, e in enumerate(edges)]
    a, b = (t.agg(F.count(column).alias("n"), *share).first() for t in (df, source))
    if not a["n"] or not b["n"]:
        return 0.0, False
    d = max(abs(a[f"e{k}"] / a["n"] - b[f"e{k}"] / b["n"]) for k in range(len(edges)))
    return d, a["n"] >= 10 and d * math.sqrt(a["n"] * b["n"] / (a["n"] + b["n"])) > KOLMOGOROV


def score(found: DataFrame) -> DataFrame:
    """One row: 1 less all penalties, not below 0, rounded to two places."""
    return found.agg(F.round(F.greatest(F.lit(0.0), 1 - F.coalesce(F.sum("penalty"), F.lit(0.0))), 2).alias("score"))
