"""Stored tables: rows in parts of their own, and versions that say which parts are current.

A part is a bucket of keys, or a source file. A change writes the parts that it touches to new folders, then a manifest
(part, path) of all current ones, and becomes current by one row that is appended to a log: nothing is overwritten that may
be read, and what fails at any point leaves the old version current. One writer at a time.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

LOG = "version bigint, layout string, schema string"
MANIFEST = "part string, path string"
PART = "__part"
#: Folders of one part; with more of them the next load rewrites it.
MOST_FOLDERS = 8


@dataclass(frozen=True)
class Version:
    """The newest version that was written to its end."""

    number: int
    layout: dict
    schema: StructType


def current(spark: SparkSession, folder: str, before: int | None = None) -> Version | None:
    """The newest version of a stored table, or the newest below `before`; None if there is none."""
    try:
        log = spark.read.schema(LOG).parquet(f"{folder}/log")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    row = (log if before is None else log.where(F.col("version") < before)).orderBy(F.desc("version")).first()
    return row and Version(row.version, json.loads(row.layout), StructType.fromJson(json.loads(row.schema)))


def manifest(spark: SparkSession, folder: str, version: Version) -> dict[str, list[str]]:
    """The folders of each part. Parts are bounded by the layout: buckets, or source files."""
    out: dict[str, list[str]] = {}
    for r in spark.read.schema(MANIFEST).parquet(f"{folder}/manifest/v{version.number}").collect():
        out.setdefault(r.part, []).append(r.path)
    return out


def read(spark: SparkSession, folder: str, version: Version | None = None, parts: list[str] | None = None) -> DataFrame | None:
    """The rows of the current version, or of the one given; of some parts only, if they are named. None if there is no table."""
    version = version or current(spark, folder)
    if version is None:
        return None
    found = manifest(spark, folder, version)
    paths = [f"{folder}/{p}" for name in (found if parts is None else parts) for p in found.get(name, ())]
    return spark.read.schema(version.schema).parquet(*paths) if paths else spark.createDataFrame([], version.schema)


def written(df: DataFrame, folder: str, name: str) -> dict[str, str]:
    """Writes rows below folder/name, by their PART; the folder of each part that has rows. Without PART it is one part."""
    path = f"{folder}/{name}"
    if PART not in df.columns:
        df.write.mode("overwrite").parquet(path)
        return {"all": name}
    df.repartition(PART).write.mode("overwrite").partitionBy(PART).parquet(path)
    files = df.sparkSession.read.schema(f"{PART} string").parquet(path).inputFiles()
    return {p.rpartition("=")[2]: f"{name}/{p.rpartition('/')[2]}" for p in {f.rpartition("/")[0] for f in files}}


def commit(spark: SparkSession, folder: str, number: int, parts: dict[str, list[str]], layout: dict, schema: StructType) -> Version:
    """Writes the manifest of a version, and then the row that makes it current."""
    rows = [(part, path) for part, paths in parts.items() for path in paths]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/v{number}")
    spark.createDataFrame([(number, json.dumps(layout), schema.json())], LOG).coalesce(1).write.mode("append").parquet(f"{folder}/log")
    return Version(number, layout, schema)


def next_number(before: Version | None) -> int:
    return 0 if before is None else before.number + 1


def joined_schema(old: StructType | None, new: StructType) -> StructType:
    """Old columns with their types, then those that are new; all may be null."""
    fields = {f.name: f for f in new.fields if f.name != PART} | {f.name: f for f in (old.fields if old else ())}
    order = [*(old.names if old else ()), *(n for n in new.names if n != PART)]
    return StructType([StructField(n, fields[n].dataType, True, fields[n].metadata) for n in dict.fromkeys(order)])


def shaped(df: DataFrame, schema: StructType) -> DataFrame:
    """The frame with a schema's columns: cast, or null where it has none, and PART as it is."""
    own = [(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema.fields]
    return df.select(*own, *([PART] if PART in df.columns else []))


def bucket(keys: list[str], buckets: int) -> Column:
    """The bucket of a row by its keys' texts, so that a key of another width stays in its bucket."""
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`").cast("string") for k in keys]), F.lit(buckets)).cast("string")


def replace(df: DataFrame, folder: str, keys: list[str] | None = None, buckets: int = 32, number: int | None = None) -> Version:
    """A version that has the frame's rows only; in buckets, if it has keys."""
    spark = df.sparkSession
    number = next_number(current(spark, folder)) if number is None else number
    own = df.withColumn(PART, bucket(keys, buckets)) if keys else df
    schema = joined_schema(None, df.schema)
    parts = written(shaped(own, schema), folder, f"data/v{number}")
    return commit(spark, folder, number, {p: [f] for p, f in parts.items()}, {"keys": keys, "buckets": buckets}, schema)


def folded(folder: str, rows: DataFrame, keys: list[str], fold, before: Version | None = None, buckets: int = 32, number: int | None = None, final: bool = True) -> Version:
    """A version in which new rows are folded into a table of buckets.

    New rows are landed by bucket. Buckets that have any of their keys are read and written anew as fold(old rows, new
    rows); the other buckets that new rows fall into get a folder more, and all others keep their files. final: new rows
    are as the table would have them, one a key, so that what was landed is that folder; else it is fold(no rows, new rows).
    Keys are matched by reading the key columns of the buckets that new rows fall into: exact, where a Bloom filter of each
    bucket would pass some in vain.
    """
    spark = rows.sparkSession
    number = next_number(before) if number is None else number
    if before is None:
        return replace(fold(None, rows), folder, keys, buckets, number)
    if before.layout["keys"] != keys:
        raise ValueError(f"the table is kept by {before.layout['keys']}, not by {keys}")
    buckets, schema = before.layout["buckets"], joined_schema(before.schema, rows.schema) if final else before.schema
    kept = {f.name: f.dataType for f in before.schema.fields if f.name in keys}
    own = shaped(rows, schema) if final else rows.withColumns({k: F.col(f"`{k}`").cast(t) for k, t in kept.items()})
    new = written(own.withColumn(PART, bucket(keys, buckets)), folder, f"data/v{number}" if final else f"landed/v{number}")
    if not new:
        return commit(spark, folder, number, manifest(spark, folder, before), before.layout, schema)
    landed = lambda some: spark.read.schema(own.schema).parquet(*[f"{folder}/{new[p]}" for p in sorted(some)])
    parts = manifest(spark, folder, before)
    keyed = [F.col(f"`{k}`") for k in keys]
    there = read(spark, folder, before, list(new)).select(*keyed)
    met = there.join(landed(new).select(*keyed), keys, "left_semi").select(bucket(keys, buckets).alias(PART)).distinct()
    hit = {r[PART] for r in met.collect()} | {p for p in new if len(parts.get(p, ())) >= MOST_FOLDERS}
    again: dict[str, str] = {}
    if hit or not final:
        made = fold(shaped(read(spark, folder, before, sorted(hit)), schema), landed(hit if final else new))
        schema = joined_schema(schema, made.schema)
        again = written(shaped(made, schema).withColumn(PART, bucket(keys, buckets)), folder, f"data/v{number}-again")
    for p, path in new.items():
        added = [again[p]] if p in again else [path] if final else []
        parts[p] = added if p in hit else [*parts.get(p, ()), *added]
    return commit(spark, folder, number, parts, before.layout, schema)
