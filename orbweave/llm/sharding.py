"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Groups are equal texts. Each group is placed, largest first, in the shard whose residual
capacity vector (bytes, tokens, rows) has the highest dot product with the group's own
vector; the smallest groups, a tenth of the bytes, go by residual bytes alone, so that the
law holds. Groups are dealt by hash to packing tasks of about ``groups_per_task``; each task
packs its groups against its own share of every shard's capacity, so the sum over tasks is
balanced when each task is, and no task or driver sees all groups. The law that holds is
``bytes``: shard sizes are near equal. A group stays whole unless it is larger than a whole
shard; such a group is cut into pieces of half a shard's capacity at most.

A group that holds many rows never meets in one task: its rows are dealt to pieces by a
hash of doc_id, and only counts per piece are packed. Groups over ``limit`` rows (at most
1 / MANY of all rows each, so fewer than MANY of them) are the only broadcast data.

Defined cases: null text has size 8 and the checksum of the empty string and forms a group
apart from empty texts; repeated rows and null doc_ids are rows of their own; an empty
table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.llm._io import cut, text_key

#: A group with over 1 / MANY of all rows (and over LEAST rows) has its rows dealt to pieces.
MANY, LEAST = 2000, 5000
#: The smallest groups, with this share of all bytes, go by the law's own dimension, which closes what joint packing left open.
CLOSING = 0.1


def _pack(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        t = pa.Table.from_batches(got)
        col = {c: t[c].to_numpy() for c in ("g1", "g2", "piece", "unit", "rows", "bytes", "tokens")}
        order = np.lexsort((col["piece"], col["unit"], col["g2"], col["g1"]))
        g1, g2, piece, unit = (col[c][order] for c in ("g1", "g2", "piece", "unit"))
        new = np.ones(len(order), bool)
        new[1:] = (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1]) | (unit[1:] != unit[:-1])
        at = np.flatnonzero(new)
        size = np.stack([np.add.reduceat(col[c][order].astype(np.float64), at) for c in ("bytes", "tokens", "rows")], 1)
        v = size / np.maximum(size.sum(0), 1)
        task = TaskContext.get().partitionId()
        residual = np.full((shards, 3), 1 / shards)
        turn = np.roll(np.arange(shards), -(task % shards))
        place = np.zeros(len(at), np.int32)
        by_size = np.lexsort((g2[at], g1[at], -size[:, 0]))
        closing = np.cumsum(v[by_size, 0]) > 1 - CLOSING
        for k, close in zip(by_size, closing, strict=True):
            j = int(np.argmax(residual[:, 0] if close else np.maximum(residual, 0) @ v[k]))
            residual[j] -= v[k]
            place[k] = turn[j]
        shard = np.repeat(place, np.diff(np.append(at, len(order))))
        rows = col["rows"][order]
        by = np.argsort(shard, kind="stable")
        before = np.cumsum(rows[by]) - rows[by]
        first = np.ones(len(by), bool)
        first[1:] = shard[by][1:] != shard[by][:-1]
        start = before - np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(by))))
        yield pa.RecordBatch.from_pydict({"g1": g1[by], "g2": g2[by], "piece": piece[by], "shard": shard[by], "task": np.full(len(by), task, np.int32), "start": start, "rows": rows[by]})

    return run


def pack(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", groups_per_task: int = 50_000) -> DataFrame:
    """One row per row of docs: key, size, tokens, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    g1, g2 = text_key(text)
    t = F.coalesce(F.col(text), F.lit(""))
    rows = cut(docs.select(
        F.col(key), g1.alias("g1"), g2.alias("g2"),
        (F.octet_length(t).cast("long") + 8).alias("size"),
        F.regexp_count(t, F.lit(r"\S+")).cast("long").alias("tokens"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
    ))
    groups = rows.groupBy("g1", "g2").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    total = groups.agg(F.count("*").alias("groups"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).first()
    limit = max(LEAST, (total.rows or 0) // MANY)
    capacity = max(1.0, (total.bytes or 0) / shards)
    large = groups.where((F.col("rows") > limit) | (F.col("bytes") > capacity)).select(
        "g1", "g2", (F.col("bytes") > capacity).alias("over"),
        F.greatest(F.ceil(F.col("rows") / limit), F.when(F.col("bytes") > capacity, F.ceil(2 * F.col("bytes") / capacity)).otherwise(1)).cast("int").alias("pieces"),
    )
    split = rows.join(F.broadcast(large), ["g1", "g2"], "left").select(
        *rows.columns, F.coalesce("over", F.lit(False)).alias("over"),
        F.coalesce(F.pmod(F.xxhash64(F.lit(3), F.col(key)), F.col("pieces")), F.lit(0)).cast("int").alias("piece"),
    )
    units = split.groupBy("g1", "g2", "piece").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.first("over").alias("over"))
    units = units.withColumn("unit", F.when(F.col("over"), F.col("piece")).otherwise(-1)).drop("over")
    tasks = max(1, -(-(total.groups or 0) // groups_per_task))
    placed = cut(units.repartition(tasks, "g1", "g2", "unit").mapInArrow(_pack(shards), "g1 long, g2 long, piece int, shard int, task int, start long, rows long"))
    ends = placed.groupBy("shard", "task").agg(F.sum("rows").alias("rows"))
    begins = ends.select("shard", "task", (F.sum("rows").over(Window.partitionBy("shard").orderBy("task")) - F.col("rows")).alias("begin"))
    placed = placed.join(begins, ["shard", "task"]).select("g1", "g2", "piece", "shard", (F.col("start") + F.col("begin")).alias("start"))
    rank = F.row_number().over(Window.partitionBy("g1", "g2", "piece").orderBy(key)) - 1
    return split.withColumn("rank", rank).join(placed, ["g1", "g2", "piece"]).select(
        key, "size", "tokens", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
