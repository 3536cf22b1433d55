"""Corpus preparation: five stages, each an operator of orbweave.llm on all that its predecessor kept.

quality      documents that the classifier rejects go (score below 0.5)
near_copies  of each group linked by 5-word shingle Jaccard similarity of 0.75 or more, the row with the smallest doc_id stays
benchmark    documents that hold a benchmark item, or a window of its size with similarity of 0.75 or more, go
secrets      every span that a secret rule finds gives way to a mark; n_chars follows the text
encode       the texts' byte-level BPE ids, counted and digested, and decoded again

All but the last return the columns of documents. Stages are written and read again
between, so none depends on another's lineage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import bpe, decontaminate, jaccard, secrets
from orbweave.llm import quality as classifier
from orbweave.llm._io import cut, fresh, table, text_key
from orbweave.llm.queries import tokenizer


def _all(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a score of 0.5 or more; learns from at most 20,000 labelled rows that are not held out."""
    (to,) = fresh(docs, "score")
    scored = classifier.score(docs, table(spark, sf_dir, "labels"), sample=20_000, to=to)
    return scored.where(F.col(to) >= 0.5).select(*_all(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: the one with the smallest doc_id, null ids last; of rows that repeat an id and its text, one.

    Rows are told apart by id and text, so other texts under a repeated id stay. Texts without words are in no
    component: of them only rows that repeat both id and text go.
    """
    own = fresh(docs, "k1", "k2")
    keyed = docs.select("*", *(k.alias(c) for k, c in zip(text_key(), own, strict=True)))
    names = ["doc_id", *own]
    gone = jaccard.copies(docs.select("doc_id", "text")).toDF("gone_id", "gone_k1", "gone_k2")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("gone_id")) & (F.col(own[0]) == F.col("gone_k1")) & (F.col(own[1]) == F.col("gone_k2"))
    kept = cut(keyed.join(gone, same, "left_anti"))
    twice = cut(kept.groupBy(*names).count().where("count > 1").select(*(F.col(c).alias(f"gone_{k}") for c, k in zip(names, ("id", "k1", "k2"), strict=True))))
    if not twice.isEmpty():
        kept = kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates(names))
    return kept.select(*_all(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_marks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts replaced by a mark."""
    clean = secrets.redact(secrets.scan(docs), mark="[SECRET]")
    if "n_chars" in clean.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return clean.select(*_all(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    path, pattern = tokenizer()
    return bpe.digests(bpe.encode_decode(docs.select("doc_id", "text"), path, pattern))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("secrets", secret_marks),
    ("encode", encode),
]

#: The first stage is a trained classifier, which SQL cannot express; tests/llm compare the others with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, each written to the shared folder and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
