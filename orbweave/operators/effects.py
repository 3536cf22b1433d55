"""Effects of treatments and exposures from observations: propensities, exposure-response curves, effects by row.

Defined cases: rows with a null treatment, exposure or outcome take no part; null confounders count as their column's median (0 if it has no
value); without rows of both kinds there are no scores and no effects.
"""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.operators.catalogs import matched_effect
from orbweave.operators.quantiles import quantiles
from orbweave.sources.io import materialized


def filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with doubles ``_x0``, ``_x1``, ... of the columns, medians for nulls."""
    for i, c in enumerate(columns):
        middle = quantiles(df, c, [0.5]).select(F.col("q")[0].alias("_m"))
        df = df.crossJoin(F.broadcast(middle)).withColumn(f"_x{i}", F.coalesce(F.col(c).cast("double"), "_m", F.lit(0.0))).drop("_m")  # one row
    return df


def propensity(df: DataFrame, treatment: str, confounders: list[str], to: str = "score") -> DataFrame:
    """df with the probability of treatment (0 or 1) given the confounders, by a logistic regression of all rows; other values of the treatment have no row."""
    x = filled(df.where(F.col(treatment).isin(0, 1)), confounders).withColumn("_label", F.col(treatment).cast("double"))
    if x.select("_label").distinct().count() < 2:
        return df.limit(0).withColumn(to, F.lit(None).cast("double"))
    parts = [VectorAssembler(inputCols=[f"_x{i}" for i in range(len(confounders))], outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_features", withMean=True), LogisticRegression(featuresCol="_features", labelCol="_label", probabilityCol="_p", predictionCol="_g", rawPredictionCol="_r", tol=1e-9)]
    x = materialized(x)
    return Pipeline(stages=parts).fit(x).transform(x).select(*df.columns, vector_to_array("_p")[1].alias(to))


def matched_by_propensity(df: DataFrame, key: str, treatment: str, outcome: str, confounders: list[str], caliper: float = 0.25) -> DataFrame:
    """``matched_effect`` on propensities, within ``caliper`` standard deviations of them."""
    scored = materialized(propensity(df, treatment, confounders, "_score"))
    sd = scored.agg(F.stddev_pop("_score")).first()[0]  # one number
    return matched_effect(scored, key, treatment, "_score", outcome, None if sd is None else caliper * max(sd, 1e-8))


#: Places of the exposure's own density; between two of them it is linear.
STEPS = 512


def exposure_response(df: DataFrame, exposure: str, outcome: str, confounders: list[str], points: int = 100, bandwidth: float | None = None) -> DataFrame:
    """point, exposure, response, weight: the mean outcome at ``points`` levels of an exposure, with confounders weighted away.

    Exposures out of the 1st to 99th percentile are left out. Each row counts by its exposure's own density over its density given the confounders (a
    normal one around a linear regression), at most the 99th percentile of that; the curve is a mean under Gaussian kernels of
    1.06 sd n^-0.2, or ``bandwidth``. The density is counted in STEPS steps of the range and smoothed by sd n^-0.2 there, so
    the work is rows and points, never pairs of rows. A kernel ends after eight bandwidths, where it is below 1e-13; levels that nothing reaches have a null response.
    """
    x = F.col(exposure).cast("double")
    there = df.where(x.isNotNull() & F.col(outcome).isNotNull()).withColumns({"_e": x, "_y": F.col(outcome).cast("double")})
    there = materialized(filled(there, confounders).select("_e", "_y", *(f"_x{i}" for i in range(len(confounders)))))
    ends = quantiles(there, "_e", [0.01, 0.99]).select(F.col("q")[0].alias("_lo"), F.col("q")[1].alias("_hi"))
    kept = materialized(there.crossJoin(F.broadcast(ends)).where(F.col("_e").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi"))  # one row
    n, low, high, sd = kept.agg(F.count("*"), F.min("_e"), F.max("_e"), F.stddev_pop("_e")).first()  # one row
    session, shape = kept.sparkSession, "point long, exposure double, response double, weight double"
    if not n:
        return session.createDataFrame([], shape)
    if not sd:
        return kept.agg(F.avg("_y").alias("response"), F.count("*").cast("double").alias("weight")).select(F.lit(0).cast("long").alias("point"), F.lit(low).alias("exposure"), "response", "weight")
    names = [f"_x{i}" for i in range(len(confounders))]
    if names:
        vectors = VectorAssembler(inputCols=names, outputCol="_v").transform(kept)
        told = LinearRegression(featuresCol="_v", labelCol="_e", predictionCol="_told", solver="normal").fit(vectors).transform(vectors).withColumn("_left", F.col("_e") - F.col("_told"))
    else:
        told = kept.withColumn("_left", F.col("_e") - (low + high) / 2)
    told = materialized(told.select("_e", "_y", "_left"))
    sigma = max(told.agg(F.stddev_pop("_left")).first()[0], 1e-8)
    step, width = (high - low) / STEPS, sd * n**-0.2
    at = F.least(F.floor((F.col("_e") - low) / step), F.lit(STEPS - 1))
    counts = kept.groupBy(at.alias("bin")).agg(F.count("*").alias("m"))  # at most STEPS rows
    edge = F.explode(F.sequence(F.lit(0), F.lit(STEPS))).alias("edge")
    gap = (F.col("edge") - F.col("bin") - 0.5) * step / width
    density = counts.select("bin", "m", edge).groupBy("edge").agg((F.sum(F.col("m") * F.exp(-gap * gap / 2)) / (n * width * (2 * F.pi()) ** 0.5)).alias("p"))
    left, right = (density.select((F.col("edge") - d).alias("bin"), F.col("p").alias(f"p{d}")) for d in (0, 1))
    own = told.withColumn("bin", at).join(F.broadcast(left), "bin").join(F.broadcast(right), "bin")  # STEPS + 1 rows
    share = (F.col("_e") - low) / step - F.col("bin")
    given = F.exp(-F.pow(F.col("_left") / sigma, 2) / 2) / (sigma * (2 * F.pi()) ** 0.5)
    own = materialized(own.select("_e", "_y", (((1 - share) * F.col("p0") + share * F.col("p1")) / F.greatest(given, F.lit(1e-10))).alias("w")))
    most = quantiles(own, "w", [0.99]).select(F.col("q")[0].alias("most"))
    own = own.crossJoin(F.broadcast(most)).select("_e", "_y", F.least("w", "most").alias("w"))  # one row
    h, pace = bandwidth or max(1.06 * sd * n**-0.2, 1e-8), (high - low) / max(points - 1, 1)
    first = F.greatest(F.ceil((F.col("_e") - low - 8 * h) / pace), F.lit(0))
    last = F.least(F.floor((F.col("_e") - low + 8 * h) / pace), F.lit(points - 1))
    spread = own.where(first <= last).select("_e", "_y", "w", F.explode(F.sequence(first, last)).alias("point"))
    z = (F.col("_e") - low - F.col("point") * pace) / h
    k = F.col("w") * F.exp(-z * z / 2)
    sums = spread.groupBy("point").agg(F.sum(k * F.col("_y")).alias("s"), F.sum(k).alias("weight"))
    every = session.range(points).select(F.col("id").alias("point"), (low + F.col("id") * pace).alias("exposure"))
    return every.join(F.broadcast(sums), "point", "left").select("point", "exposure", F.when(F.col("weight") > 1e-10, F.col("s") / F.col("weight")).alias("response"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


#: Models that learn side by side.
TOGETHER = 3


def effects_by_row(df: DataFrame, key: str, treatment: str, outcome: str, features: list[str], folds: int = 5, trees: int = 20, depth: int = 4) -> DataFrame:
    """Each row with ``fold`` and ``effect``: what a model of treated rows tells for it less what a model of untreated rows does.

    The models (boosted trees) of a fold learn from the other folds' rows alone; the fold is the key's crc32 modulo ``folds``. A row whose models would have no rows
    to learn from has a null effect.
    """
    there = materialized(df.where(F.col(treatment).isin(0, 1) & F.col(outcome).isNotNull()))  # medians and folds read it many times
    x = filled(there, features).withColumns({"fold": (F.crc32(F.col(key).cast("string")) % folds).cast("int"), "_label": F.col(outcome).cast("double")})
    x = materialized(VectorAssembler(inputCols=[f"_x{i}" for i in range(len(features))], outputCol="_features").transform(x))
    seen = {(r.fold, r[1]): r.n for r in x.groupBy("fold", treatment).agg(F.count("*").alias("n")).collect()}  # twice the folds
    enough = [all(any(n for (f, t), n in seen.items() if f != fold and t == kind) for kind in (0, 1)) for fold in range(folds)]
    names = {1: "_with", 0: "_without"}

    def fitted(one: tuple[int, int]):
        fold, kind = one
        learn = x.where((F.col("fold") != fold) & (F.col(treatment) == kind))
        return GBTRegressor(featuresCol="_features", labelCol="_label", predictionCol=names[kind], maxIter=trees, maxDepth=depth, stepSize=0.1, seed=42).fit(learn)

    asked = [(fold, kind) for fold in range(folds) if enough[fold] for kind in names]
    with ThreadPool(TOGETHER) as pool:  # a tree's level is a short job
        models = dict(zip(asked, pool.map(inheritable_thread_target(x.sparkSession)(fitted), asked, chunksize=1)))
    parts = []
    for fold in range(folds):
        held = x.where(F.col("fold") == fold)
        for kind in names if enough[fold] else ():
            held = models[fold, kind].transform(held)
        effect: Column = F.col("_with") - F.col("_without") if enough[fold] else F.lit(None).cast("double")
        parts.append(held.select(*df.columns, "fold", effect.alias("effect")))
    return reduce(DataFrame.unionAll, parts)


def average_effect(effects: DataFrame) -> DataFrame:
    """n, effect, se, low, high: the mean of effects by row and its 95 % interval."""
    one = effects.agg(F.count("effect").alias("n"), F.avg("effect").alias("effect"), F.try_divide(F.stddev_pop("effect"), F.sqrt(F.count("effect"))).alias("se"))
    return one.select("*", (F.col("effect") - 1.96 * F.col("se")).alias("low"), (F.col("effect") + 1.96 * F.col("se")).alias("high"))
