"""Incremental loads: what is new, upserts by key, and state that moves only after the write."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from galena.functions.failures import FAILURES, failure
from galena.functions.names import INSERT_ONLY_NAMES, MONOTONIC_ENDS, WATERMARK_NAMES, ends_with
from galena.functions.types import TEMPORAL, logical_type
from galena.sources import stored

#: How many rows of the source a landed row stands for.
COPIES = "_copies"
STATE = "dataset string, watermark_column string, watermark string, rows_total bigint"


@dataclass(frozen=True)
class Watermark:
    """The column that tells new rows. insert_only: it does not move when a row is changed."""

    column: str | None
    reason: str
    insert_only: bool = False


def choose_watermark(df: DataFrame) -> Watermark:
    """A conventional name (by priority, temporal only), any temporal column, a growing integer key, or none."""
    kinds = {f.name: logical_type(f.dataType) for f in df.schema.fields}
    by_name = {c.lower(): c for c, k in kinds.items() if k in TEMPORAL}
    for name in WATERMARK_NAMES:
        if name in by_name:
            return Watermark(by_name[name], "a conventional name", name in INSERT_ONLY_NAMES)
    for c, k in kinds.items():
        if k in TEMPORAL:
            return Watermark(c, "the first temporal column")
    for c, k in kinds.items():
        if k == "integer" and ends_with(c, MONOTONIC_ENDS):
            return Watermark(c, "a growing key: changes of old rows are not seen", True)
    return Watermark(None, "no column tells new rows, so all are read")


@dataclass(frozen=True)
class Window_:
    """ceiling: the largest watermark, as a value; mark: the same as text that no time zone changes (see as_mark)."""

    rows: DataFrame
    column: str | None
    ceiling: object
    null_rows: int
    reason: str
    mark: str | None = None


def as_mark(x: Column, kind: str) -> Column:
    """A watermark as text: a timestamp as microseconds since 1970, whatever zone session and process are in."""
    return (F.unix_micros(x) if kind == "timestamp" else x).cast("string")


def from_mark(mark: str, kind: str) -> Column:
    return F.timestamp_micros(F.lit(int(mark))) if kind == "timestamp" else F.lit(mark).cast(kind)


def read_window(df: DataFrame, last_column: str | None = None, since=None, inclusive: bool = False, mark: str | None = None) -> Window_:
    """Rows above `since` (a value) or `mark` (its text), up to the maximum as it is before the read; a new watermark column
    starts afresh.

    Rows without a watermark come with a full read only; their number is told. inclusive reads the rows at `since`
    again, for tables that get more rows of a value already seen (an upsert makes that harmless).
    """
    chosen = choose_watermark(df)
    if chosen.column is None:
        return Window_(df, None, None, 0, chosen.reason)
    x, kind = F.col(f"`{chosen.column}`"), df.schema[chosen.column].dataType.simpleString()
    ceiling, nulls, top = df.agg(F.max(x), F.count_if(x.isNull()), as_mark(F.max(x), kind)).first()
    low = from_mark(mark, kind) if mark is not None else F.lit(since) if since is not None else None
    rows = df
    if low is not None and chosen.column == last_column:
        rows = rows.where((x >= low if inclusive else x > low) & (x <= from_mark(top, kind))) if top is not None else rows.where("false")
    elif top is not None:
        rows = rows.where(x.isNull() | (x <= from_mark(top, kind)))
    return Window_(rows, chosen.column, ceiling, nulls, chosen.reason, top)


def changed_files(listing: DataFrame, registry: DataFrame) -> DataFrame:
    """Files of the listing (path, length, modificationTime, maybe etag) whose version no successful load has.

    A version is the etag, or size and time; failed versions come again.
    """
    stamp = F.concat_ws("-", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))
    version = F.coalesce(F.col("etag"), stamp) if "etag" in listing.columns else stamp
    done = registry.where(F.col("status") == "LOADED").select("path", "version").distinct()
    return listing.withColumn("version", version).join(done, ["path", "version"], "left_anti")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).drop("content")


def latest_per_key(source: DataFrame, keys: list[str], order: str | None, copies: str | None = None) -> DataFrame:
    """One row a key: the last by `order`. Which of equal ones is settled by the rest of the row. copies: a column for the
    number of rows that the key had."""
    by = [F.col(f"`{order}`").desc_nulls_last()] if order else []
    rest = [F.col(f"`{c}`").desc_nulls_last() for c in source.columns if c not in keys and c != order]
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*(by + rest or [F.lit(1)])))
    own = source.withColumn(copies, F.count(F.lit(1)).over(Window.partitionBy(*keys))) if copies else source
    return own.withColumn("__rn", rn).where("__rn = 1").drop("__rn")


def upsert(target: DataFrame | None, source: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The target with the source's rows in place of those of their keys; rows of null key never match.

    All-key tables only gain rows. Without keys there is no upsert. Doing it twice changes nothing.
    """
    if not keys:
        raise ValueError("an upsert needs keys")
    if missing := [k for k in keys if k not in source.columns]:
        raise ValueError(f"no key column {missing[0]}")
    once = latest_per_key(source, keys, order)
    if target is None:
        return once
    same = keys if set(keys) != set(source.columns) else source.columns
    return once.unionByName(target.join(once.select(*same), same, "left_anti"), allowMissingColumns=True)


def load_bronze(source: DataFrame, root: str, dataset: str, keys: list[str], state: DataFrame | None, full: bool = False, buckets: int = 32) -> dict:
    """Reads what is new into the bronze table below root, and only then advances the state.

    Tables with keys are stored in buckets: an upsert rewrites those that hold a key of the new rows, and no other (see
    stored.folded). Without keys, in full, or where state or table is missing, all rows are read and replace the table.
    The source is read once: its rows are counted as copies of the rows that are landed.
    """
    spark, folder = source.sparkSession, bronze_folder(root, dataset)
    before = stored.current(spark, folder)
    last = state.where(F.col("dataset") == dataset).first() if state is not None else None
    replace = full or not keys or last is None or before is None or before.layout["keys"] != keys
    window = read_window(source, last and last.watermark_column, mark=None if replace else last.watermark)
    if not keys:
        version = stored.replace(window.rows, folder)
        read = stored.read(spark, folder, version).count()
    else:
        own = latest_per_key(window.rows, keys, window.column, copies=COPIES)
        if replace:
            version = stored.replace(own, folder, keys, buckets)
        else:
            version = stored.folded(folder, own, keys, lambda old, new: upsert(old, new, keys, window.column), before)
        read = landed_rows(spark, folder, version.number)
    total = read if replace else last.rows_total + read
    top = window.mark if window.mark is not None or replace else last.watermark
    moved = [(dataset, window.column, top, total)]
    return {"folder": folder, "version": version.number, "rows_read": read, "mode": "replace" if replace else "upsert", "reason": window.reason, "state": spark.createDataFrame(moved, STATE)}


def bronze_folder(root: str, dataset: str) -> str:
    return f"{root}/bronze/{dataset}"


def read_bronze(spark: SparkSession, root: str, dataset: str) -> DataFrame | None:
    """The rows of a bronze table as they are now."""
    now = stored.read(spark, bronze_folder(root, dataset))
    return now and now.drop(COPIES)


def landed_rows(spark: SparkSession, folder: str, number: int) -> int:
    """Rows that a load read, from the numbers of copies of those it landed."""
    try:
        return spark.read.schema(f"{COPIES} bigint").parquet(f"{folder}/data/v{number}").agg(F.coalesce(F.sum(COPIES), F.lit(0))).first()[0]
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return 0
        raise


REGISTRY = "path string, version string, status string, reason string, loaded bigint"


def read_registry(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """What loads of files have left: a row for each attempt, LOADED or FAILED with the reason."""
    try:
        return spark.read.schema(REGISTRY).parquet(f"{root}/files/{dataset}")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], REGISTRY)
        raise


def load_files(listing: DataFrame, root: str, dataset: str, schema: StructType, form: str = "parquet", **options) -> DataFrame:
    """Loads the files of the listing that are new, changed, or failed before, each in place of what it had; the rows that
    were appended to the registry are returned.

    The bronze table has a part for each source file. All files are read in one job; if it fails, halves of them are tried,
    so that a broken file costs a few jobs more and keeps no other out. Its rows of before stay. The registry is appended to
    after the table's version is current: a load that is lost between the two comes again and changes nothing.
    """
    spark, folder = listing.sparkSession, bronze_folder(root, dataset)
    todo = changed_files(listing, read_registry(spark, root, dataset)).select("path", "version").orderBy("path").collect()
    before = stored.current(spark, folder)
    number = stored.next_number(before)
    parts = stored.manifest(spark, folder, before) if before else {}
    done: list[tuple[str, str, str, str | None]] = []

    def attempt(files: list[Row], name: str) -> None:
        own = spark.read.schema(schema).format(form).options(**options).load([f.path for f in files])
        path = F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))  # as the listing has it
        source = F.md5(F.regexp_replace(path, "^file:/+", "file:/")).alias(stored.PART)
        try:
            new = stored.written(own.select("*", source), folder, f"data/v{number}/{name}")
        except FAILURES as why:
            if len(files) == 1:
                done.append((files[0].path, files[0].version, "FAILED", failure(why)))
                return
            half = len(files) // 2
            attempt(files[:half], f"{name}0")
            attempt(files[half:], f"{name}1")
            return
        for f in files:
            part = file_part(f.path)
            parts[part] = [new[part]] if part in new else []
            done.append((f.path, f.version, "LOADED", None))

    if todo:
        attempt(todo, "t")
    if any(status == "LOADED" for _, _, status, _ in done):
        stored.commit(spark, folder, number, parts, {"keys": None, "buckets": None}, stored.joined_schema(None, schema))
    added = spark.createDataFrame(done, "path string, version string, status string, reason string").withColumn("loaded", F.unix_micros(F.current_timestamp()))
    if done:
        added.coalesce(1).write.mode("append").parquet(f"{root}/files/{dataset}")
    return added


def file_part(path: str) -> str:
    """The part of a source file: a digest of its path, with one slash after file: as Spark writes it."""
    return hashlib.md5(re.sub("^file:/+", "file:/", path).encode()).hexdigest()


def read_state(spark: SparkSession, root: str) -> DataFrame | None:
    """The latest state of each dataset, from the log of states; None before the first load."""
    try:
        log = spark.read.schema(f"{STATE}, loaded bigint").parquet(f"{root}/state")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return log.groupBy("dataset").agg(F.max_by(F.struct(*[c for c in log.columns if c != "dataset"]), "loaded").alias("s")).select("dataset", "s.*").drop("loaded")


def save_state(state: DataFrame, root: str) -> None:
    """Appends a state to the log of states; the time of appending orders the states of a dataset."""
    state.withColumn("loaded", F.unix_micros(F.current_timestamp())).coalesce(1).write.mode("append").parquet(f"{root}/state")
