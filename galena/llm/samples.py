"""Bounded samples of labelled rows, and one-task fits on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.llm.shared import batches, give_back, small_batches

#: Labelled rows that a fit looks at, at most. Texts of this many rows are what the fitting task holds.
MAX_TRAIN = 8_000


def held_out(key: Column) -> Column:
    """Rows never learned from: crc32 of the key as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, also: tuple[str, ...] = ()) -> DataFrame:
    """Documents (key, text and the columns in also) with their labels: all labelled rows that are not held out, or `most` of them by key hash.

    Labels with null keys are left out; of several rows for a key the first by value counts. The sample of keys is
    bounded by `most`, which is what makes it safe to broadcast. Of several documents of a key the one of the smallest
    text hash counts, so that the sample has as many rows as keys at most.
    """
    names = [c for c in labels.columns if c != "key"]
    one = labels.where(F.col("key").isNotNull() & ~held_out(F.col("key"))).groupBy("key").agg(F.min(F.struct(*names)).alias("l")).select("key", "l.*")
    chosen = one.orderBy(F.xxhash64("key"), "key").limit(most)
    found = docs.select("key", "text", *also).join(F.broadcast(chosen), "key")
    row = F.struct("text", *also, *names)
    return found.groupBy("key").agg(F.min_by(row, F.xxhash64("text")).alias("r")).select("key", "r.*")


def fit_in_one_task(sample: DataFrame, fit: Callable[[list[dict]], dict], schema: str) -> dict:
    """What fit makes of the rows of a bounded sample, run in one task; rows come ordered by key and text."""
    small_batches(sample.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches(frames) for r in b.to_pylist()]
        rows.sort(key=lambda r: (r["key"], r["text"] or ""))
        made = pa.RecordBatch.from_pylist([fit(rows)])
        del rows
        give_back()
        yield made

    made = sample.repartition(1).mapInArrow(run, schema).first()
    return made.asDict() if made else fit([])  # Spark runs no task for a sample that it knows to be empty
