"""Texts as chunks of bounded length that keep paragraphs and sentences whole where they fit."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PARAGRAPHS = re.compile(r"\n[^\S\n]*\n\s*")
_SENTENCE = re.compile(r"[^。！？.!?\n]*[。！？.!?\n]*\s*")


def _pieces(text: str, longest: int, overlap: int) -> Iterator[str]:
    """Paragraphs; of those that are too long, runs of whole sentences; of sentences that are too long, windows that overlap."""
    for paragraph in (p.strip() for p in _PARAGRAPHS.split(text)):
        if len(paragraph) <= longest:
            if paragraph:
                yield paragraph
            continue
        held = ""
        for sentence in (s.strip() for s in _SENTENCE.findall(paragraph)):
            if not sentence:
                continue
            if held and len(held) + 1 + len(sentence) > longest:
                yield held
                held = ""
            held = f"{held} {sentence}" if held else sentence
            while len(held) > longest:
                yield held[:longest]
                held = held[longest - overlap :]
        if held:
            yield held


def cut(text: str, longest: int, overlap: int) -> list[str]:
    """Chunks of one text: pieces joined by a blank line while they fit; a new chunk begins with the last ``overlap`` characters of the one before."""
    out, now = [], ""
    for piece in _pieces(text, longest, overlap):
        if not now:
            now = piece
        elif len(now) + 2 + len(piece) <= longest:
            now = f"{now}\n\n{piece}"
        else:
            out.append(now)
            tail = now[-overlap:] if 0 < overlap < len(now) else ""
            now = f"{tail}\n\n{piece}" if tail else piece
    return [*out, now] if now else out


def chunked(df: DataFrame, key: str, text: str, longest: int = 500, overlap: int = 50) -> DataFrame:
    """key, chunk (from 0), text: every text in chunks by paragraphs and sentences.

    A piece has at most ``longest`` characters; a chunk adds the overlap and a blank line at most. Null and blank texts give no chunk. Rows are
    cut where they are read: nothing is shuffled.
    """
    if not 0 <= overlap < longest:
        raise ValueError("overlap must be below longest")
    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    kind = T.StructType([source.schema["key"], T.StructField("chunk", T.IntegerType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                got = [(i, k, c) for i, t in enumerate(part.column("text").to_pylist()) for k, c in enumerate(cut(t, longest, overlap))]
                rows = pa.array([g[0] for g in got], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("key").take(rows), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.string())], ["key", "chunk", "text"])

    return source.mapInArrow(run, kind).withColumnRenamed("key", key)
