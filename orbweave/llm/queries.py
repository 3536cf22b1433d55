"""The registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import bpe, codes, counts, decontaminate, infill, jaccard, mixing, oracles, quality, secrets, sharding, simhash, suffixes, topk
from orbweave.llm._io import table


def tokenizer(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path and pre-token pattern of a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5, scale=256)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.pack(table(spark, sf_dir, "documents"), shards=24)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.report(quality.score(docs, table(spark, sf_dir, "labels"), sample=20_000))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(suffixes.remove(table(spark, sf_dir, "documents"), span=400))


#: The edits of op6: every secret and every e-mail address gives way to a mark. An address is looked for at the start of a run of its
#: letters only, and the run is not given back, so a text takes time in proportion to its length.
EMAIL = secrets.Rule("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+")
MARKS = {r.kind: "[SECRET]" for r in secrets.RULES} | {"email": "[EMAIL]"}


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer()
    docs = counts.redactions(table(spark, sf_dir, "documents").select("doc_id", "text"), (*secrets.RULES, EMAIL), MARKS)
    return counts.count(docs, path, pattern).select("doc_id", "n_tokens", "n_edits", "n_passed", "n_tokens_edited", "n_reencoded")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents").select("doc_id", "text"), num=3, den=4, width=5)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer()
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(infill.invert(infill.transform(table(spark, sf_dir, "documents").select("doc_id", "text"), rate=90, spm=20)))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = codes.encode(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, radius=4, seed=42)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_top_k": op1_top_k,
    "op2_decontamination": op2_decontamination,
    "op3_sharding": op3_sharding,
    "op4_quality": op4_quality,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_secret_scans": op8_secret_scans,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_infill": op11_infill,
    "op12_vector_codes": op12_vector_codes,
    "op13_simhash": op13_simhash,
}
ORACLES: dict[str, str] = {"op1_top_k": oracles.TOP_K, "op8_secret_scans": oracles.SECRETS, "op11_infill": oracles.INFILL, "op12_vector_codes": oracles.CODES}
