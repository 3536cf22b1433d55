"""Data quality: rules are rows of small literals, checks are single aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column the share in percent that is neither null nor blank, with pass (95), warn (80) or fail."""
    row = df.agg(F.count("*").alias("n"), *(F.count_if(F.trim(F.col(c).cast("string")) != "").alias(c) for c in columns))
    each = F.array(*(F.struct(F.lit(c).alias("column"), (F.col(c) * 100.0 / F.col("n")).alias("percent")) for c in columns))
    p = F.col("percent")
    return row.select(F.explode(each).alias("x")).select("x.*").withColumn("grade", F.when(p >= 95, "pass").when(p >= 80, "warn").otherwise("fail"))


def ranges(df: DataFrame, rules: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows below and above the limits of each column; a column that is not there counts every row."""
    have = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c) < lo).alias("below"), F.count_if(F.col(c) > hi).alias("above")) for c, (lo, hi) in rules.items() if c in df.columns]
    none = [F.struct(F.lit(c).alias("column"), F.count("*").alias("below"), F.count("*").alias("above")) for c in rules if c not in df.columns]
    return df.agg(F.array(*have, *none).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def formula(df: DataFrame, left: str, right: str, tolerance: float) -> DataFrame:
    """How often left = right within the tolerance does not hold, and the largest difference."""
    d = F.abs(F.expr(left) - F.expr(right))
    return df.agg(F.count("*").alias("rows"), F.count_if(d > tolerance).alias("violations"), F.max(d).alias("largest"))


def defects(df: DataFrame, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """code -> (severity, SQL condition of a bad row): rows with each defect."""
    row = df.agg(F.count("*").alias("n"), *(F.count_if(F.expr(cond)).alias(code) for code, (_, cond) in rules.items()))
    each = F.array(*(F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(code).alias("found")) for code, (severity, _) in rules.items()))
    return row.select("n", F.explode(each).alias("x")).select("x.*", "n")


#: Points taken for a defect by severity.
WEIGHTS = {"A": 12.0, "B": 4.0, "C": 1.0}


def defect_score(found: DataFrame) -> DataFrame:
    """100 less the weighted share of defects."""
    w = reduce(lambda a, kv: F.when(F.col("severity") == kv[0], kv[1]).otherwise(a), WEIGHTS.items(), F.lit(0.0))
    return found.agg(F.greatest(F.lit(0.0), 100 - F.sum(w * F.col("found")) / F.max("n") * 100).alias("score"))


def conflicts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose sources disagree: two or more distinct texts that are not null."""
    kinds = F.size(F.array_distinct(F.array_compact(F.array(*(F.col(c).cast("string") for c in columns)))))
    return df.withColumn("n_values", kinds).where("n_values >= 2")


def resolve(df: DataFrame, columns: list[str], to: str) -> DataFrame:
    """The first source that is not null, in order of priority, and which one it was."""
    source = reduce(lambda a, c: F.when(F.col(c).isNotNull(), c).otherwise(a), reversed(columns), F.lit(None).cast("string"))
    return df.withColumns({to: F.coalesce(*columns), f"{to}_source": source})


#: What counts as personal data; one character before an @ is enough to find an address.
PII = {
    "email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "mobile": r"(?:^|[^0-9])1[3-9][0-9]{9}(?:[^0-9]|$)",
    "ipv4": r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}",
}


def pii(df: DataFrame, column: str) -> DataFrame:
    """Rows that match each kind of personal data, over the whole column."""
    # Only texts that hold an expression's literal are searched with it.
    may = {"email": F.contains(F.col(column), F.lit("@")), "ipv4": F.contains(F.col(column), F.lit("."))}
    row = df.agg(*(F.count_if(may.get(k, F.lit(True)) & F.regexp_like(F.col(column), F.lit(p))).alias(k) for k, p in PII.items()))
    return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("found")) for k in PII))).alias("x")).select("x.*")
