"""The operators as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from galena.operators import quality as Q
from galena.operators.history import scd2_events
from galena.operators.ingest import latest_per_key, upsert
from galena.sources import stored


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of a streamed table."""
    return stored.read(spark, path)


def _folded(stream: DataFrame, path: str, keys: list[str], checkpoint: str, fold, once=None) -> StreamingQuery:
    """Each batch makes the next version of a stored table, in which only the buckets of its keys are written anew.

    once: what makes the rows of a batch rows of the table, one a key; without it only fold does. A batch that is run again
    starts from the version before it, and its version is written again.
    """

    def batch(rows: DataFrame, number: int) -> None:
        before = stored.current(rows.sparkSession, path, before=number)
        stored.folded(path, once(rows) if once else rows, keys, fold, before, number=number, final=once is not None)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_ingest(spark: SparkSession, folder: str, schema, path: str, keys: list[str], checkpoint: str, order: str | None = None) -> StreamingQuery:
    """New files of a folder are upserted into a table; the checkpoint knows which files were read.

    Files are known by path: one that is changed in place takes load_files().
    """
    stream = spark.readStream.schema(schema).parquet(folder)
    return _folded(stream, path, keys, checkpoint, lambda old, rows: upsert(old, rows, keys, order), lambda rows: latest_per_key(rows, keys, order))


def stream_scd2(stream: DataFrame, path: str, keys: list[str], time: str, checkpoint: str) -> StreamingQuery:
    """Each batch is merged into the history by the times of its rows: see scd2_events()."""
    tracked = [c for c in stream.columns if c not in (*keys, time)]
    return _folded(stream, path, keys, checkpoint, lambda old, rows: scd2_events(old, rows, keys, time, tracked))


def stream_quality(stream: DataFrame, rules, clean_path: str, quarantine_path: str, checkpoint: str, run_id: str) -> StreamingQuery:
    """Clean and rejected rows of each batch, in folders named by batch: a batch that is run again replaces its own."""

    def batch(rows: DataFrame, number: int) -> None:
        judged = Q.evaluate(rows, rules).persist()
        Q.clean(judged).write.mode("overwrite").parquet(f"{clean_path}/batch={number}")
        Q.quarantine(judged, run_id, F.current_timestamp()).write.mode("overwrite").parquet(f"{quarantine_path}/batch={number}")
        judged.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_dedupe(stream: DataFrame, columns: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each combination within the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(columns)


def stream_summary(stream: DataFrame, time: str, dimensions: list[str], measures: list[str], delay: str = "1 hour", grain: str = "1 day") -> DataFrame:
    """Counts, totals and averages by window of time; rows later than the delay are left out."""
    values = [v for m in measures for v in (F.sum(m).alias(f"total_{m}"), F.avg(m).alias(f"avg_{m}"))]
    out = stream.withWatermark(time, delay).groupBy(F.window(time, grain).alias("w"), *dimensions).agg(F.count(F.lit(1)).alias("record_count"), *values)
    return out.select(F.col("w.start").alias("period"), *dimensions, "record_count", *[c for m in measures for c in (f"total_{m}", f"avg_{m}")])
