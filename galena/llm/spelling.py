"""Spelling variants: words one edit apart, grouped under their most frequent form.

Near words are found by asymmetric q-chunks. Of two words the longer one (of equally long ones the smaller) contributes
two disjoint chunks, its halves; one edit leaves one of them whole. The half that the edit breaks is parted once more in
the same way, so that a key is a whole half and the whole quarter beside the edit: three quarters of a word. The other
word contributes its positional grams of the same sizes. What is whole before the edit stands at the same place in both,
what is whole after it one place earlier in the word that lacks a letter, so that grams at other places are not made and
the join is one of equal keys. Whatever shares a key is verified by its edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.llm.shared import batches, dropped, give_back, small_batches, tidy, written

RUN = re.compile("[a-zÀ-ÿ]+")
#: Words that a task counts before it hands them on (some 150 bytes each).
HELD = 200_000


def noised(start: int, word: str, every: int) -> str:
    """The word, without one letter if `every` divides the checksum that goes on from `start`."""
    h = zlib.crc32(word.encode(), start)
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(df: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 5, least: int = 3, every: int = 97) -> DataFrame:
    """word, n: the words of all texts that have `shortest` code points and occur `least` times at least.

    Words are runs of RUN, with A-Z in lower case. A run of which the crc32 of `<key>:<run>` is divisible by `every` loses
    the letter at that number modulo its length. Null texts have no words; a null key counts as no text before the colon.
    """
    small_batches(df.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for b in batches(frames):
            for own, t in zip(b.column("key").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                start = zlib.crc32(f"{own or ''}:".encode())
                for word, n in Counter(RUN.findall(t.lower().decode())).items():  # bytes are lowered in A-Z only
                    word = noised(start, word, every)
                    if len(word) >= shortest:
                        held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield handed()
        if held:
            yield handed()
        give_back()

    own = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where("text is not null")
    counted = own.mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def part(word: Column, start: Column | int, end: Column) -> Column:
    """word[start:end]."""
    return F.substring(word, F.lit(start) + 1, end - start)


def pieces(word: Column, size: Column, shift: int) -> list[Column]:
    """The four keys that a word has in common with words of `size` letters, one for each quarter that the edit may be
    in, from the last to the first. shift: the letters that the word lacks; what follows the edit stands so much earlier."""
    half = F.floor(size / 2).cast("int")
    first, third = F.floor(half / 2).cast("int"), half + F.floor((size - half) / 2).cast("int")
    whole = F.length(word)
    tail = lambda at: part(word, at - shift, whole)
    head = lambda at: part(word, 0, at)
    none = F.lit("")
    return [F.struct(head(third).alias("head"), none.alias("tail")), F.struct(head(half).alias("head"), tail(third).alias("tail")),
            F.struct(head(first).alias("head"), tail(half).alias("tail")), F.struct(none.alias("head"), tail(first).alias("tail"))]


def keyed(words: DataFrame, shift: int) -> DataFrame:
    """word, n, quarter, code: a row for each key that the word shares with words that have `shift` letters more."""
    size = F.length("word") + shift
    coded = [F.struct(F.lit(i).alias("quarter"), F.xxhash64(size, F.lit(i), p["head"], p["tail"]).alias("code")) for i, p in enumerate(pieces(F.col("word"), size, shift))]
    return words.select("word", "n", F.inline(F.array(*coded)))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: each two words (word, n; words distinct) that one inserted, deleted or replaced code point parts,
    once. a is the longer word, of equally long ones the smaller."""
    chunks = keyed(words, 0).toDF("a", "a_n", "quarter", "code")
    grams = keyed(words, 0).withColumn("shift", F.lit(0)).unionByName(keyed(words, 1).withColumn("shift", F.lit(1)))
    grams = grams.toDF("b", "b_n", "b_quarter", "b_code", "shift")
    met = chunks.join(grams, (F.col("code") == F.col("b_code")) & (F.col("quarter") == F.col("b_quarter")) & ((F.col("shift") == 1) | (F.col("a") < F.col("b"))))
    size = F.length("a")
    mine = pieces(F.col("a"), size, 0)
    same = [F.when(F.col("shift") == 0, x == y).otherwise(x == z) for x, y, z in zip(mine, pieces(F.col("b"), size, 0), pieces(F.col("b"), size, 1), strict=True)]
    earlier = F.lit(3)  # a run of one letter across a border matches in several quarters; the first of them counts
    for i in (2, 1, 0):
        earlier = F.when(same[i], i).otherwise(earlier)
    longer = F.length("b") + F.col("shift") == size
    return met.where(longer & (F.levenshtein("a", "b", 1) == 1) & (earlier == F.col("quarter"))).select("a", "a_n", "b", "b_n")


def with_forms(words: DataFrame, pairs: DataFrame, times: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n: how many near words each word has, and the one of them that occurs most often
    (ties: the smallest), if it does `times` as often as the word."""
    both = pairs.select(F.inline(F.array(
        F.struct(F.col("a").alias("of"), F.col("b").alias("by"), F.col("b_n").alias("by_n")),
        F.struct(F.col("b").alias("of"), F.col("a").alias("by"), F.col("a_n").alias("by_n")),
    )))
    most = both.groupBy("of").agg(F.count("*").alias("near"), F.min_by(F.struct("by", "by_n"), F.struct(-F.col("by_n"), "by")).alias("best"))
    joined = words.join(most, F.col("word") == F.col("of"), "left")
    holds = F.col("best.by_n") >= times * F.col("n")
    return joined.select("word", "n", F.coalesce("near", F.lit(0)).alias("n_near"), F.when(holds, F.col("best.by")).alias("form"), F.when(holds, F.col("best.by_n")).alias("form_n"))


def with_roots(formed: DataFrame) -> DataFrame:
    """The frame and root: the word at the end of the chain of forms. Each round doubles the steps that are taken, and a
    form is `times` as frequent as what it stands for, so that chains are as long as a logarithm of the counts."""
    ahead = written(formed.where("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = ahead.select(F.col("word").alias("at"), F.col("root").alias("beyond"))
        moved = ahead.join(onward, F.col("root") == F.col("at"), "left")
        step = written(moved.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            break
        dropped(ahead)
        ahead = step.drop("moved")
    ends = ahead.select(F.col("word").alias("from_word"), "root")
    return formed.join(ends, F.col("word") == F.col("from_word"), "left").drop("from_word").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(df: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 5, least: int = 3, times: int = 2, every: int = 97) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the texts (see word_counts): form is its near word of largest
    n, if that is `times` its own or more, else null; root is what forms lead to, the word itself if it has none.

    All words and all pairs count. Copies of a row count as often as they are there; without texts there are no rows.
    Columns besides key and text are not looked at.
    """
    tidy(df.sparkSession)
    words = written(word_counts(df, key, text, shortest, least, every), "words")
    formed = written(with_forms(words, near_pairs(words), times), "formed")
    return with_roots(formed).select("word", "form", "root", "n", "n_near", "form_n")
