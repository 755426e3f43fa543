"""Exact substring dedup over the whole corpus: distributed prefix doubling on the positions that matter.

Every start of a `WIDTH`-byte string (a window) that occurs elsewhere is to be found, and all bytes that such windows
cover. Ranking all positions would shuffle the corpus many times over, so the positions that are ranked are sampled by
content: equal strings have their samples at equal places.

1. runs: a window's anchor is the place of its smallest GRAM-byte hash (leftmost of equals). Consecutive windows with one
   anchor are a run. Runs with equal bytes from the first window's start to the last one's end repeat as a whole and are
   done; a window can only repeat if its anchor's gram does. What is left of both are the open runs.
2. doubling: within open runs, positions whose gram hash is smaller than those of NEAR positions on either side are
   sampled. The rank of a position at step 0 is that of the bytes up to the next sampled position. Spark then ranks, for
   steps 1, 2, 4 ... positions, the pairs (rank here, rank so many positions on) of the step before. A rank that only one
   position has is unique, and so is all that holds it; ranks past the threshold of WIDTH bytes are not made.
3. windows: all sampled positions within a window are covered by two ranks of the largest step that fits, which overlap.
   They and the few bytes before and after are what the window is: windows with a unique rank are gone, of the others
   those that Spark finds twice repeat. Windows without a sampled position (periodic bytes) are taken by all their bytes.

Bytes between positions are compared by 64-bit hashes, windows by two of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galena.llm.shared import batches, dropped, small_batches, tidy, written

WIDTH, GRAM, NEAR = 400, 32, 24
#: Sampled positions lie more than NEAR bytes apart, so this many steps of doubling pass the threshold.
STEPS = ((WIDTH - GRAM - 2 * NEAR) // (NEAR + 1)).bit_length()
#: Window starts of a text that are hashed at once, as a power of two.
PART_BITS = 18
PART = 1 << PART_BITS
BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(PART + WIDTH + 1, np.uint64(base), np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each stretch of `size` bytes."""
    if len(data) < size:
        return np.empty(0, np.uint64)
    up, down = powers()
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    x = (total[size:] - total[:-size]) * down[: len(data) - size + 1]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each stretch of `width` values, by stretches of doubling width."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def runs_of(text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """For each part of a text: first and last window start, anchor, and hashes of gram and run, of each run."""
    for at in range(0, max(0, len(text) - WIDTH + 1), PART):
        part = text[at : at + PART + WIDTH - 1]
        grams = rolling(np.frombuffer(part, np.uint8), GRAM)
        low = np.uint64(PART * 2 - 1)
        least = sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), WIDTH - GRAM + 1)
        anchor = (least & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        last = np.append(first[1:], len(anchor)) - 1
        whole = np.array([xxhash.xxh64_intdigest(part[a : b + WIDTH]) for a, b in zip(first.tolist(), last.tolist(), strict=True)], np.uint64)
        yield first + at, last + at, anchor[first] + at, grams[anchor[first]].view(np.int64), whole.view(np.int64)


def find_runs(docs: DataFrame) -> DataFrame:
    """key, first, last, anchor, gram, whole for each run of each document."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                for first, last, anchor, gram, whole in runs_of(text or b""):
                    cols = [pa.array(np.full(len(first), key, np.int64)), *(pa.array(c) for c in (first, last, anchor, gram, whole))]
                    yield pa.RecordBatch.from_arrays(cols, names=["key", "first", "last", "anchor", "gram", "whole"])

    return docs.mapInArrow(run, "key bigint, first bigint, last bigint, anchor bigint, gram bigint, whole bigint")


def with_texts(runs: DataFrame, docs: DataFrame) -> DataFrame:
    """text and all runs of a document (as many as it has bytes, at most) in one row.

    Runs of equal rows are whole repeats of each other, so a run that is looked at here has one row only, or stands for
    its class; then each copy of the row gives its windows again, which is what they are.
    """
    grouped = runs.groupBy("key").agg(F.collect_list(F.struct("first", "last", "rep")).alias("runs"))
    return docs.join(grouped, "key")


def sampled(text: bytes, first: int, end: int) -> np.ndarray:
    """The sampled positions whose surroundings (NEAR grams on either side) lie within text[first:end]."""
    found = []
    for at in range(first, end, PART):
        grams = rolling(np.frombuffer(text[at : min(end, at + PART + GRAM + 2 * NEAR - 1)], np.uint8), GRAM)
        if len(grams) > 2 * NEAR:
            least = sliding_min(grams, NEAR)
            own = grams[NEAR:-NEAR]
            found.append(np.flatnonzero((own < least[: len(own)]) & (own < least[NEAR + 1 :])) + at + NEAR)
    return np.concatenate(found) if found else np.empty(0, np.int64)


def joined(first: np.ndarray, end: np.ndarray, kind: np.ndarray, gap: int) -> list[tuple[int, int, int]]:
    """Ranges [first, end) of one kind that lie at most `gap` apart (the next one's first minus the end), as one each."""
    order = np.argsort(first, kind="stable")
    first, end, kind = first[order], np.maximum.accumulate(end[order]) if len(order) else end, kind[order]
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] - end[:-1] > gap) | (kind[1:] != kind[:-1])
    starts = np.flatnonzero(new)
    return list(zip(first[starts].tolist(), end[np.append(starts[1:], len(first)) - 1].tolist(), kind[starts].tolist(), strict=True))


def listed(batch: pa.RecordBatch, column: str, *fields: str) -> Iterator[tuple[np.ndarray, ...]]:
    """For each row of a batch the fields of a column of lists of structs, as arrays; nulls are 0, no list is empty."""
    lists = batch.column(column)
    offsets, values = lists.offsets.to_numpy(), lists.values
    flat = [values.field(f).cast(pa.int64()).fill_null(0).to_numpy() for f in fields]
    some = lists.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(lists)):
        at = slice(offsets[i], offsets[i + 1] if some[i] else offsets[i])
        yield tuple(x[at] for x in flat)


def phrases(runs: DataFrame, docs: DataFrame) -> DataFrame:
    """key, stretch (its start), k (number within), p, rank: the sampled positions of the open runs, with the hash of the
    bytes up to the next one; null for the last of a stretch."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            for key, text, (first_, last_) in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), listed(b, "runs", "first", "last"), strict=True):
                for first, end, _ in joined(first_, last_ + WIDTH, np.zeros(len(first_), np.int64), 0):
                    at = sampled(text, first, end)
                    if len(at):
                        ends = at.tolist()
                        ranks = [xxhash.xxh64_intdigest(text[x:y]) - (1 << 63) for x, y in zip(ends[:-1], ends[1:], strict=True)]
                        n = len(at)
                        cols = [pa.array(c) for c in (np.full(n, key, np.int64), np.full(n, first, np.int64), np.arange(n), at.astype(np.int64))]
                        yield pa.RecordBatch.from_arrays([*cols, pa.array([*ranks, None], pa.int64())], names=["key", "stretch", "k", "p", "rank"])

    made = with_texts(runs, docs).mapInArrow(run, "key bigint, stretch bigint, k bigint, p bigint, rank bigint")
    return made.dropDuplicates(["key", "stretch", "k"])  # equal rows of docs give theirs once


def doubled(positions: DataFrame) -> DataFrame:
    """positions (a written table, which is dropped) with r0, r1 ...: the ranks of the bytes from each over 1, 2, 4 ... phrases. 0: only this position has
    them; null: they are past the end or the threshold."""
    along = Window.partitionBy("key", "stretch").orderBy("k")
    ranked, names = positions.withColumn("a", F.col("rank")).withColumn("b", F.lit(0).cast("bigint")), []
    for i in range(STEPS):
        step = 1 << i
        if i:
            near = [F.lead(names[-1], step // 2).over(along).alias("b"), F.lead("p", step).over(along).alias("far")]
            ranked = ranked.select("*", *near)
            fits = F.col("far") - F.col("p") <= WIDTH - GRAM - 2 * NEAR
            both = F.when(fits, F.col(names[-1])), F.when(fits, F.col("b"))
            ranked = ranked.withColumns({"a": both[0], "b": both[1]}).drop("far")
        open_ = F.col("a").isNotNull() & F.col("b").isNotNull() & ((F.col("a") != 0) & ((F.col("b") != 0) | F.lit(not i)))
        name = F.min(F.xxhash64("key", "p")) if i else F.max("a")
        twice = ranked.where(open_).groupBy("a", "b").agg(F.count(F.lit(1)).alias("many"), name.alias("name")).where("many > 1").select("a", "b", "name")
        own = f"r{i}"
        rank = F.when(F.col("open"), F.coalesce("name", F.lit(0))).when(F.col("a").isNotNull(), 0)
        # Positions that are settled look for nothing, each by a number of its own, so that they do not meet in one task.
        asked = ranked.withColumn("open", open_).withColumn("a_", F.when(F.col("open"), F.col("a")).otherwise(F.xxhash64("key", "p"))).withColumn("b_", F.when(F.col("open"), F.col("b")).otherwise(0))
        twice = twice.select(F.col("a").alias("a_"), F.col("b").alias("b_"), "name")
        before, ranked = positions, written(asked.join(twice, ["a_", "b_"], "left").select("key", "stretch", "k", "p", *names, rank.alias(own)), "ranks")
        dropped(before)
        positions = ranked
        names.append(own)
    return ranked


def mixed(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit hash of several values a row."""
    x = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        x = (x ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def window_ids(data: np.ndarray, first: int, places: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the windows of data, whose first byte is at `first`: two hashes that tell each, and whether it can repeat.

    places are the sampled positions of the text, ranks a row for each step of doubling.
    """
    up, down = powers()
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    hashed = lambda x, y: (total[y] - total[x]) * down[x]
    start = np.arange(len(data) - WIDTH + 1)
    a = np.searchsorted(places, start + first + NEAR)
    b = np.searchsorted(places, start + first + WIDTH - GRAM - NEAR, side="right") - 1
    n = b - a
    left, right, can = mixed(hashed(start, start + WIDTH)), np.full(len(start), 1, np.uint64), np.ones(len(start), bool)
    some = np.flatnonzero(n >= 0)
    if len(some):
        i, a, b, n = start[some], a[some], b[some], n[some]
        step = np.maximum(np.frexp(np.maximum(n, 1))[1] - 1, 0)  # the largest power of two that n phrases hold
        ra = np.where(n > 0, ranks[step, a], 1)
        rb = np.where(n > 0, ranks[step, np.maximum(b - (1 << step), a)], 1)
        pa_, pb = places[a] - first, places[b] - first
        left[some] = mixed(hashed(i, pa_), pa_ - i, ra.view(np.uint64))
        right[some] = mixed(hashed(pb, i + WIDTH), n + 2, rb.view(np.uint64))
        can[some] = (ra != 0) & (rb != 0)
    return left, right, can


def windows(runs: DataFrame, positions: DataFrame, docs: DataFrame) -> DataFrame:
    """left, right, key, start, rep of every window of the runs that has no unique rank."""
    names = [f"r{i}" for i in range(STEPS)]
    ranks = positions.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("p", *names))).alias("positions"))
    both = with_texts(runs, docs).join(ranks, "key", "left")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            texts, ranked = b.column("text").to_pylist(), listed(b, "positions", "p", *names)
            for key, text, (first_, last_, rep_), (places, *rank) in zip(b.column("key").to_pylist(), texts, listed(b, "runs", "first", "last", "rep"), ranked, strict=True):
                held, size, rank = [], 0, np.stack(rank)
                # Runs side by side are looked at together, in parts that the table of powers covers.
                parts = [(x, min(x + PART, end), rep) for first, end, rep in joined(first_, last_ + 1, rep_, 0) for x in range(first, end, PART)]
                for first, end, rep in parts:
                    data = np.frombuffer(text, np.uint8)[first : end - 1 + WIDTH]
                    left, right, can = window_ids(data, first, places, rank)
                    at = np.flatnonzero(can)
                    held.append((left[at].view(np.int64), right[at].view(np.int64), np.full(len(at), key, np.int64), at + first, np.full(len(at), bool(rep))))
                    size += len(at)
                    if size > 100_000:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=["left", "right", "key", "start", "rep"])
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=["left", "right", "key", "start", "rep"])

    return both.mapInArrow(run, "left bigint, right bigint, key bigint, start bigint, rep boolean")


def repeated(docs: DataFrame) -> DataFrame:
    """key, first, last: stretches of window starts that occur elsewhere. docs: key, text (binary)."""
    found = written(find_runs(docs), "runs")
    classes = found.groupBy("gram", "whole").agg(F.count(F.lit(1)).alias("same"), F.min(F.struct("key", "first", "last", "anchor")).alias("one"))
    classes = written(classes, "run-classes")
    # Runs that occur as a whole more than once are done: every window of theirs repeats.
    whole = written(found.join(classes.where("same > 1").select("gram", "whole"), ["gram", "whole"], "left_semi").select("key", "first", "last"), "whole-runs")
    # Grams with a run that is not, and another one: the single runs, and one run to stand for each class of the others.
    grams = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.min("same").alias("least")).where("kinds > 1 and least = 1").select("gram")
    open_ = written(classes.join(grams, "gram").select("one.*", "gram", (F.col("same") > 1).alias("rep")), "open-runs")
    dropped(found, classes)
    ranks = doubled(written(phrases(open_, docs), "positions"))
    ranked = written(windows(open_, ranks, docs), "windows")
    dropped(open_, ranks)
    twice = ranked.groupBy("left", "right").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("left", "right")
    single = ranked.where("not rep").join(twice, ["left", "right"], "left_semi").select("key", F.col("start").alias("first"), F.col("start").alias("last"))
    stretches = written(whole.unionByName(single), "stretches")
    dropped(whole, ranked)
    return stretches


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: key, n_bytes, n_removed, n_spans, kept (the remaining bytes).

    A byte is removed if any WIDTH-byte string that covers it starts anywhere else, in this or another row. Null texts
    count as empty, shorter ones than WIDTH lose nothing. Rows that are equal in key and text are copies of each other
    like any others, so both lose what is long enough. Other columns are not looked at.
    """
    small_batches(df.sparkSession)
    tidy(df.sparkSession)
    data = F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8")
    docs = df.select(F.col(key).alias("of"), F.xxhash64(F.col(key), F.lit(key), F.col(text)).alias("key"), data.alias("text"))
    spans = repeated(docs.select("key", "text")).groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("spans"))

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for t, (first, last) in zip(b.column("text").to_pylist(), listed(b, "spans", "first", "last"), strict=True):
                spans = joined(first, last + WIDTH, np.zeros(len(first), np.int64), 0) if len(first) else []
                parts, at = [], 0
                for x, end, _ in spans:
                    parts.append(t[at:x])
                    at = end
                parts.append(t[at:])
                kept.append(b"".join(parts))
                n_bytes.append(len(t))
                n_removed.append(len(t) - len(kept[-1]))
                n_spans.append(len(spans))
            yield pa.RecordBatch.from_arrays([b.column("of"), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.binary())], names=["of", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema["of"].dataType.simpleString()
    out = docs.join(spans, "key", "left").select("of", "text", "spans").mapInArrow(cut, f"of {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.withColumnRenamed("of", key)
