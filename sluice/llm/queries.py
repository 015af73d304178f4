"""The numbered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import byte_bpe, decontam, langid, lines, mixing, ngram_join, periods, pii, suffix_dedup, tokens, topk, urls, whitening
from sluice.llm.common import WORD, read_table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(read_table(spark, sf_dir, "documents")).drop("kept")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(read_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document of the same number: bad if of low quality or toxic."""
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return urls.judge(read_table(spark, sf_dir, "pages"), labels).select("page_id", "host", "path", "rule", "verdict")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single lines of 50 words or more are passages by themselves here."""
    return lines.dedup_lines(read_table(spark, sf_dir, "documents"), passage=50).select("doc_id", "n_lines", "n_removed", "text")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, added = [k.name for k in pii.BASE], [k.name for k in pii.ADDED]
    found = pii.detect(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(pii.written(base), 256).alias("base_sha256"),
        pii.written(base + added).alias("spans"),
    )


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = tokens.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"), most=16)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    found = byte_bpe.decode(byte_bpe.encode(read_table(spark, sf_dir, "documents"), path, pattern), path)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.find_runs(periods.planted(read_table(spark, sf_dir, "documents"), WORD))
    found = found.withColumn("top", periods.strongest(F.col("runs")))
    written = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col("top")[c].alias(c) for c in ("start", "length", "period")),
        F.expr("(1000 * top.length) div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(written, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


NUMBERED = (op1_suffix_dedup, op2_topk, op3_ngram_join, op4_mixing, op5_language, op6_urls, op7_lines, op8_decontamination, op9_pii, op10_tokens, op11_whitening, op12_byte_bpe, op13_periods)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in NUMBERED}
