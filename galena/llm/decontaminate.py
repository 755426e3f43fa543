"""Benchmark decontamination by winnowing, by DataFrame functions only.

Words are hashed, k-grams of words are hashed, and of each window of neighbouring k-grams the smallest hash is kept: a
fingerprint. A span of `span` words has span - k + 1 k-grams, one window, so two texts that share the span share its
fingerprint; runs of windows with one minimum give it once. Documents' and items' fingerprints are joined, and only what
meets is extended to the whole span by the spans' own hashes. Items shorter than a span are one window of their own length,
for which every k-gram (k: that length) is a fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.llm.exprs import LOWER, MARKS, UPPER, covered, grams, least_of, let, upto, words
from galena.llm.shared import written

SPAN, K = 13, 5
#: Benchmarks of up to so many windows (24 bytes each) are broadcast; larger ones are joined by shuffles.
SMALL_WINDOWS = 200_000


def hashed_words(text: Column) -> Column:
    return F.transform(words(F.translate(text, UPPER, LOWER), MARKS), lambda w: F.xxhash64(w))


def fingerprints(h: Column, span: int, k: int) -> Column:
    """Structs (print, start, h): each minimum k-gram hash with the run of windows that it is the minimum of.

    start is the 1-based place of the run's first window, h the word hashes that the run's spans are made of.
    """
    window = span - k + 1

    def runs(least: Column) -> Column:
        starts = F.filter(upto(F.size(least)), lambda i: (i == 1) | (F.get(least, i - 1) != F.get(least, F.greatest(i - 2, F.lit(0)))))
        run = lambda s: F.transform(
            s,
            lambda i, j: F.struct(
                F.get(least, i - 1).alias("print"),
                i.alias("start"),
                F.slice(h, i, F.coalesce(F.get(s, j + 1), F.size(least) + 1) - i + (span - 1)).alias("h"),
            ),
        )
        return let(starts, run)

    return let(grams(h, k), lambda g: let(least_of(g, window), runs))


def windows_of(items: DataFrame, span: int, k: int) -> DataFrame:
    """The items' windows: item, len, print and whole (hash of the window's words). Items without words have none."""
    h = items.select("item", hashed_words(F.col("text")).alias("h")).where(F.size("h") > 0)
    long = h.where(F.size("h") >= span).select("item", F.lit(span).alias("len"), F.explode(fingerprints(F.col("h"), span, k)).alias("f"))
    long = long.select("item", "len", "f.print", F.explode(grams(F.col("f.h"), span)).alias("whole"))
    short = h.where(F.size("h") < span)
    short = short.select("item", F.size("h").alias("len"), *[F.xxhash64(F.size("h"), "h").alias(c) for c in ("print", "whole")])
    return long.unionByName(short).distinct()


def find_hits(docs: DataFrame, windows: DataFrame, lengths: list[int], span: int, k: int, small: bool) -> DataFrame:
    """For each document a row with n_words, and one for each benchmark window found: len, whole, starts."""

    none = F.array().cast("array<bigint>")

    def hit(print_: Column, start: Column, h: Column, n: int) -> Column:
        return F.struct(print_.alias("print"), start.alias("start"), h.alias("h"), F.lit(n).alias("len"), F.lit(None).cast("int").alias("n_words"))

    def rows(h: Column) -> Column:
        own = F.array(F.struct(F.xxhash64("key", "digest").alias("print"), F.lit(0).alias("start"), none.alias("h"), F.lit(0).alias("len"), F.size(h).alias("n_words")))
        found = lambda n: (
            F.transform(fingerprints(h, span, k), lambda f: hit(f["print"], f["start"], f["h"], span))
            if n == span
            else F.transform(grams(h, n), lambda g, i: hit(g, i + 1, none, n))
        )
        parts = [own, *map(found, lengths)]
        return F.concat(*parts)

    prints = docs.select("key", "digest", F.explode(let(hashed_words(F.col("text")), rows)).alias("f")).select("key", "digest", "f.*")
    known = windows.select(F.col("print").alias("known"), F.col("len").alias("known_len"), "whole").distinct()
    both = prints.join(F.broadcast(known) if small else known, (F.col("print") == F.col("known")) & (F.col("len") == F.col("known_len")), "left")
    # Whole spans are hashed where the join has met; a short item's window is its print.
    spans = F.when(F.col("len") == span, grams(F.col("h"), span)).otherwise(F.array("print"))
    found = F.array_contains(spans, F.coalesce("whole", F.lit(0)))
    both = both.where(F.col("n_words").isNotNull() | (F.col("whole").isNotNull() & found))
    starts = let(spans, lambda s: F.transform(F.filter(upto(F.size(s)), lambda i: F.get(s, i - 1) == F.col("whole")), lambda i: F.col("start") + i - 1))
    return both.select("key", "digest", "n_words", "len", F.when(F.col("n_words").isNull(), F.col("whole")).alias("whole"), F.when(F.col("n_words").isNull(), starts).alias("starts"))


def decontaminate(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", span: int = SPAN, k: int = K) -> DataFrame:
    """One row per row of df: key, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in an occurrence of any item's window; contaminated: at least a twentieth of the words is.
    Null texts have no words. Null keys and repeated rows are kept; rows of one key with different texts are judged by
    themselves. Items of null id count for hits, not in n_items; repeated items count once. An empty benchmark hits
    nothing. Other columns are not looked at.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(key).alias("key"), F.md5(own).alias("digest"), own.alias("text"))
    windows = written(windows_of(benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")), span, k), "benchmark-windows")
    small = windows.count() <= SMALL_WINDOWS
    lengths = sorted(r["len"] for r in windows.select("len").distinct().collect())  # span of them at most
    hits = written(find_hits(docs, windows, lengths, span, k, small), "benchmark-hits")

    # Sets, so that copies of a row, however many, add nothing to what is gathered of it.
    spans = F.flatten(F.collect_set(F.transform("starts", lambda s: F.struct(s.alias("start"), F.col("len").alias("len")))))
    by_doc = hits.groupBy("key", "digest").agg(F.max("n_words").cast("bigint").alias("n_words"), F.count("n_words").alias("copies"), spans.alias("spans"))
    named = windows.where(F.col("item").isNotNull()).select("whole", "len", "item").distinct()
    found = hits.where(F.col("whole").isNotNull()).select("key", "digest", "whole", "len").distinct()
    items = found.join(F.broadcast(named) if small else named, ["whole", "len"]).groupBy("key", "digest").agg(F.array_sort(F.collect_set("item")).alias("items"))
    items = items.select(F.col("key").alias("of"), F.col("digest").alias("of_digest"), "items")
    both = by_doc.join(items, F.col("key").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest")), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    out = both.select(
        F.col("key").alias(key),
        "n_words",
        covered(F.col("spans")).cast("bigint").alias("n_hit"),
        F.size(listed).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
