"""Token counts through a digest cache.

A text's normalised form is digested, and so is the tokenizer with its library's version. The pair finds a stored
count; only distinct texts without one are encoded, and their counts are appended to the cache.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.llm.shared import batches, shared_path, small_batches, written

CACHE = "tokenizer string, digest binary, n_tokens bigint"
#: Words whose counts one worker remembers, and the longest of them in bytes.
WORDS, WORD_BYTES = 500_000, 64
#: Blanks that the word vocabularies drop, and that no token crosses: [ \t\n\v\f\r].
BLANKS = r"[\x20\x09-\x0D]+"


def tokenizer_digest(path: str) -> str:
    """Digest of the vocabulary file and the version of the library that reads it."""
    import sentencepiece
    import tokenizers

    version = tokenizers.__version__ if path.endswith(".json") else sentencepiece.__version__
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + version.encode()).hexdigest()


@lru_cache(maxsize=4)
def counter(path: str):
    """A function from texts to token counts. Vocabularies that drop blanks are counted word by word, by memo."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(own.encode(t.decode(), num_threads=1)) for t in texts]
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    many = lambda texts: [len(e.ids) for e in own.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
    if not drops_blanks(path):
        return lambda texts: [n for i in range(0, len(texts), 16) for n in many(texts[i : i + 16])]
    known: dict[bytes, int] = {}

    def count(texts: list[bytes]) -> list[int]:
        words = [t.split() for t in texts]  # bytes are cut at BLANKS
        if len(known) > WORDS:
            known.clear()
        new = [w for w in set().union(*words) if w not in known] if words else []
        long = {}
        for i in range(0, len(new), 4096):
            for w, n in zip(new[i : i + 4096], many(new[i : i + 4096]), strict=True):
                (known if len(w) <= WORD_BYTES else long)[w] = n
        return [sum([long[w] if w in long else known[w] for w in ws] if long else map(known.__getitem__, ws)) for ws in words]

    return count


@lru_cache(maxsize=4)
def drops_blanks(path: str) -> bool:
    """Whether blanks only part words for a tokenizer, so that a text counts as the sum of its words.

    That takes a vocabulary with endings of words, a split that keeps no blank, normalisers that look at no more than a
    word and leave blanks blank, and added tokens that hold and swallow none. Whatever is not known to be so is counted by
    whole texts.
    """
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    pre, normal = told.get("pre_tokenizer") or {}, told.get("normalizer")
    split = (pre.get("pretokenizers") or [{}])[0]
    parts = split.get("type") == "Split" and split.get("behavior") == "Removed" and "\\s" not in split["pattern"].get("Regex", "\\s").replace("[^\\s", "")
    steps = normal.get("normalizers", [normal]) if normal else []
    blanks = lambda n: n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " "
    by_word = all(n["type"] in ("NFC", "Lowercase") or blanks(n) for n in steps)
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not any(c.isspace() for c in t["content"]) for t in told.get("added_tokens", []))
    whole = not told.get("truncation") and not told.get("padding") and not told["model"].get("dropout")
    return bool(told["model"].get("end_of_word_suffix") and parts and by_word and added and whole)


def normal_form(text, drops: bool):
    """The text as the cache knows it: null as empty; where blanks count for nothing, runs of them as one."""
    own = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(own, BLANKS, " ")) if drops else own


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache at a path, created empty if there is none; counts stored twice are read once."""
    spark.createDataFrame([], CACHE).write.mode("ignore").partitionBy("tokenizer").parquet(path)
    return spark.read.schema(CACHE).parquet(path)


def count_tokens(df: DataFrame, tokenizer: str, cache: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: key, n_bytes (UTF-8, of the text as it is) and n_tokens.

    A null text counts as empty (0 bytes, 0 tokens); null and repeated keys are kept as they are. Columns other than
    key and text are not looked at. cache is a folder that all executors reach; None takes a new one.
    """
    spark = df.sparkSession
    small_batches(spark)
    cache, version = cache or shared_path(spark, "token-counts"), tokenizer_digest(tokenizer)
    own = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    digest = F.unhex(F.sha2(normal_form(F.col("text"), drops_blanks(tokenizer)), 256))
    seen = written(own.select("key", digest.alias("digest"), F.octet_length("text").cast("bigint").alias("n_bytes")), "text-digests")
    stored = open_cache(spark, cache).where(F.col("tokenizer") == version)
    # One row stands for each missing digest. Its text is found by row and digest, so that many copies of a text are
    # spread like any other rows; only one of them is shuffled on.
    row = F.xxhash64(F.coalesce(F.col("key").cast("string"), F.lit("")), "digest")
    missing = seen.join(stored.select("digest"), "digest", "left_anti").groupBy("digest").agg(F.min(row).alias("row"))
    texts = own.select("text", digest.alias("digest"), "key").select("text", "digest", row.alias("row"))
    chosen = texts.join(missing, ["row", "digest"], "left_semi").select("digest", "text")

    def encode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for b in batches(frames):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(count(texts), pa.int64())], names=["digest", "n_tokens"])

    fresh = chosen.mapInArrow(encode, "digest binary, n_tokens bigint").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    fresh.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    counts = open_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return seen.join(written(counts, "token-counts-once"), "digest").select(F.col("key").alias(key), "n_bytes", "n_tokens")
