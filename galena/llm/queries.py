"""The corpus operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.llm import byte_bpe, decontaminate, language_id, line_align, ngram_join, oracles, quality_nbsvm, quality_rules, spelling, sstable, suffix_dedup, token_counts, toxicity_chain, whitening


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns or ("doc_id", "text"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text."""
    return quality_nbsvm.score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, category by category."""
    scored = toxicity_chain.score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", *[f"p_{c}" for c in toxicity_chain.CATEGORIES], F.col("rejected").alias("toxic"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's shingles and the component that its links reach."""
    return ngram_join.similarity_components(documents(spark, sf_dir))


def op3_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's shingles, class of equal sets and number of linked texts."""
    return ngram_join.link_counts(documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text by the word vocabulary, through the digest cache."""
    counted = token_counts.count_tokens(documents(spark, sf_dir), byte_bpe.vocabulary_path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by the ranks and decoded again."""
    from public_tokenizers import PATTERN

    path = byte_bpe.vocabulary_path("byte_bpe_multi_50k.tiktoken")
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = byte_bpe.encode_frame(docs, path, PATTERN, decoded="decoded")
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every text is left without the 400-byte strings that occur elsewhere."""
    out = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("has_repeat"))


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids written to sorted-string-table shards and read back."""
    return sstable.encode_to_shards(documents(spark, sf_dir), byte_bpe.vocabulary_path("byte_bpe_50k.json"), 2)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every text, how many of them go, and a digest of what is kept."""
    out = line_align.dedupe_lines(documents(spark, sf_dir), lines="n_lines", removed="n_removed")
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and risk-controlled verdicts of every text."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality_rules.apply_rules(documents(spark, sf_dir, "doc_id", "lang", "text"), labels)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text against the whole benchmark."""
    return decontaminate.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts with their near words, forms and roots."""
    return spelling.spelling_variants(documents(spark, sf_dir))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the 32 whitened components of largest variance."""
    white = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return white.withColumn("deviation", F.col("deviation").cast("bigint"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, and how many spans of languages it has."""
    found = language_id.identify_languages(documents(spark, sf_dir, "doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_toxicity": op2_toxicity,
    "op3_ngram_join": op3_ngram_join,
    "op3_ngram_links": op3_ngram_links,
    "op4_token_counts": op4_token_counts,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_token_shards": op7_token_shards,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_decontamination": op10_decontamination,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_whitening": op12_whitening,
    "op13_language_id": op13_language_id,
}

ORACLE_SQL: dict[str, str] = {"op3_ngram_join": oracles.OP3, "op6_suffix_dedup": oracles.OP6, "op8_line_dedup": oracles.OP8, "op9_quality_rules": oracles.OP9, "op10_decontamination": oracles.OP10, "op11_spelling_variants": oracles.OP11}
