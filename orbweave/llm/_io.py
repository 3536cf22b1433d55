"""Sessions, scratch tables and small shared expressions of the operators."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only where none is named, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext.master.startswith(("local[", "local-cluster")) and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = held.get() if held.isDefined() else f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return root.rstrip("/")


def written(df: DataFrame, by: tuple[str, ...] = ()) -> str:
    """df computed once and written to a new folder of the shared one, in a folder for each value of ``by``: its path."""
    out = f"{scratch(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(out)
    return out


def cut(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared folder: lineage ends there, and lost executors don't matter."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df))


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that written() made and that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release() -> None:
    """Gives memory that arrays have left back to the system: workers live on between tasks, and several share an executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def text_key(col: str = "text") -> list[Column]:
    """Two 64-bit hashes that stand for a whole text; null is a text of its own."""
    return [F.xxhash64(F.lit(1), F.col(col), F.col(col).isNull()), F.xxhash64(F.lit(2), F.col(col), F.col(col).isNull())]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column of df."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def answered(rows: DataFrame, answers: DataFrame, key: str, value: str, often: int = 1000) -> DataFrame:
    """rows with the ``value`` of their key; answers: one row for each key of rows, null included, with value and ``n``, its number of rows.

    Keys with more than a part in ``often`` of all rows are fewer than ``often`` and go to every task; the others meet by
    shuffle, so no key fills a task. Both tables are read twice: pass written ones.
    """
    many = F.col("n") > F.lit((answers.agg(F.sum("n")).first()[0] or 0) / often)
    as_key = answers.withColumnRenamed(key, "own_key")
    same = F.col(key).eqNullSafe(F.col("own_key"))
    hot = rows.join(F.broadcast(as_key.where(many).select("own_key", value)), same)
    rest = rows.join(F.broadcast(as_key.where(many).select("own_key")), same, "left_anti").join(as_key.where(~many).select("own_key", value), same)
    return hot.drop("own_key").unionByName(rest.drop("own_key"))


def parts(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
