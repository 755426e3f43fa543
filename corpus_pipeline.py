"""The corpus pipeline over `documents`: toxicity, line dedup, near duplicates, decontamination, token ids.

Each stage takes (spark, docs, sf_dir) and gets what the stage before kept, read again from Parquet. All but the last
return the columns of `documents`. Running n_chars is kept true to the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.llm import byte_bpe, decontaminate, line_align, ngram_join, toxicity_chain
from galena.llm.shared import free_name, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    return toxicity_chain.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has go; a document with nothing else left goes with them. Null texts and
    repeated rows stay: copies of a row count as one document."""
    lines, removed = free_name(docs, "n_lines_"), free_name(docs, "n_removed_")
    cut = line_align.dedupe_lines(docs, lines=lines, removed=removed)
    left = (F.col(removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    length = F.when(F.col(removed) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return cut.where(left).withColumn("n_chars", length).select([f"`{c}`" for c in docs.columns])


def told_by_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a hash of id and text, and its column's name: rows that are equal in both have one, all others their own."""
    row = free_name(docs, "row_hash")
    return docs.withColumn(row, F.xxhash64("doc_id", F.lit("of"), "text")), row


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links reach, one row stays: that of the smallest doc_id, null last, among rows of one id that of
    the smallest hash. Rows without shingles all stay. Repeated rows link like any others."""
    own, row = told_by_row(docs)
    placed = ngram_join.similarity_components(own.select(row, "text"), key=row)
    placed = placed.groupBy(row).agg(F.max("component_id").alias("component"), F.max("n_shingles").alias("n"))
    ids = own.groupBy(F.col(row).alias("of")).agg(F.max("doc_id").alias("id"))
    first = F.min_by("of", F.struct(F.col("id").isNull(), "id", "of")).alias("of")
    ranked = placed.join(ids, F.col(row) == F.col("of"))
    chosen = ranked.where("n > 0").groupBy("component").agg(first).select("of", F.lit(True).alias("once"))
    keep = written(chosen.unionByName(ranked.where("n = 0").select("of", F.lit(False).alias("once"))), "kept")
    kept = own.join(keep.hint("merge"), F.col(row) == F.col("of"))
    single, rest = kept.where("once").dropDuplicates([row]), kept.where("not once")
    return single.unionByName(rest).select([f"`{c}`" for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which at least a twentieth of the words lies in benchmark windows go, each judged by its own text."""
    own, row = told_by_row(docs)
    judged = decontaminate.decontaminate(own.select(row, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=row)
    bad = written(judged.where("contaminated").select(F.col(row).alias("bad")).distinct(), "contaminated")
    return own.join(bad.hint("merge"), F.col(row) == F.col("bad"), "left_anti").select([f"`{c}`" for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and whether they decode to the same bytes."""
    from public_tokenizers import PATTERN

    path = byte_bpe.vocabulary_path("byte_bpe_multi_50k.tiktoken")
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = byte_bpe.encode_frame(own, path, PATTERN, decoded="decoded")
    same = (F.col("decoded") == F.encode("text", "utf-8")).alias("round_trip")
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", same)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedupe_lines),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("token ids", encode),
]

#: The first stage is a learned model, which SQL does not express; tests/llm/test_pipeline.py holds the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's rows written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
