"""Slowly changing dimensions: versions of rows with the time that each was true."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galena.operators.ingest import latest_per_key

FROM, TO, CURRENT, HASH = "_valid_from", "_valid_to", "_is_current", "_row_hash"


def change_hash(tracked: list[str]):
    """A hash of the tracked columns, in order of their names; null differs from any text and keeps its place."""
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("<null>")) for c in sorted(tracked)]
    return F.md5(F.concat_ws("|", *parts))


def tracked_of(target: DataFrame) -> list[str] | None:
    """The columns that a history was versioned by, as its hash column tells; None where it does not."""
    return target.schema[HASH].metadata.get("tracked") if HASH in target.columns else None


def tracking(target: DataFrame | None, source: DataFrame, keys: list[str], tracked: list[str] | None, others: tuple[str, ...] = ()) -> tuple[list[str], bool]:
    """The tracked columns, and whether the history has been versioned by others: then every current row gets a version
    anew, and a warning says so."""
    tracked = sorted(tracked or [c for c in source.columns if c not in keys and c not in others])
    before = tracked_of(target) if target is not None else None
    if moved := before is not None and sorted(before) != tracked:
        warnings.warn(f"the history was versioned by {', '.join(sorted(before))}, now by {', '.join(tracked)}: current rows get new versions", stacklevel=3)
    return tracked, moved


def hashed(df: DataFrame, tracked: list[str]) -> DataFrame:
    return df.withColumn(HASH, change_hash(tracked).alias(HASH, metadata={"tracked": tracked}))


def scd2_merge(target: DataFrame | None, source: DataFrame, keys: list[str], as_of, tracked: list[str] | None = None) -> DataFrame:
    """The whole history after a load: changed rows are closed and followed by their new version.

    Rows that did not change, and keys that the source lacks, stay as they are. as_of is the one time of this load.
    Source rows with a null key are left out; of several for one key, one is taken. Replaying a load changes nothing. A
    set of tracked columns that differs from the history's is warned of, and all rows that the source has get new versions.
    Closed versions pass by: only open ones are joined.
    """
    if not keys:
        raise ValueError("a history needs keys")
    tracked, _ = tracking(target, source, keys, tracked)
    at = F.lit(as_of).cast("timestamp")
    own = hashed(latest_per_key(source.dropna(subset=keys), keys, None), tracked)
    if target is None:
        return own.select(*source.columns, HASH, at.alias(FROM), F.lit(None).cast("timestamp").alias(TO), F.lit(True).alias(CURRENT))
    # A full join of open versions and new rows. A pair that differs gives two rows, the closed version and the new one.
    columns = [*target.columns, *(c for c in source.columns if c not in target.columns)]
    kinds = {f.name: f.dataType for f in [*source.schema.fields, *target.schema.fields]}
    side = lambda df, name: df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))
    old, new = side(target.where(CURRENT), "old"), side(own, "new")
    both = old.join(new, [F.col(f"old.`{k}`") == F.col(f"new.`{k}`") for k in keys], "full")
    changed = F.coalesce(F.col(f"old.{HASH}") != F.col(f"new.{HASH}"), F.lit(False))
    closed = {TO: F.when(changed, at).otherwise(F.col(f"old.{TO}")), CURRENT: ~changed}
    opened = {HASH: F.col(f"new.{HASH}"), FROM: at, TO: F.lit(None), CURRENT: F.lit(True)}
    row = lambda name, df, given: F.struct(*[given.get(c, F.col(f"{name}.`{c}`") if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in columns])
    versions = F.array(F.when(F.col("old").isNotNull(), row("old", target, closed)), F.when(F.col("new").isNotNull() & (F.col("old").isNull() | changed), row("new", own, opened)))
    open_ = both.select(F.explode(F.array_compact(versions)).alias("v")).select("v.*")
    ended = target.where(~F.coalesce(F.col(CURRENT), F.lit(False))).select(*[(F.col(f"`{c}`") if c in target.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in columns])
    return told(open_.unionByName(ended), tracked)


def told(history: DataFrame, tracked: list[str]) -> DataFrame:
    """The history, whose hash column says what it is versioned by."""
    return history.withMetadata(HASH, {"tracked": tracked})


def scd2_events(target: DataFrame | None, changes: DataFrame, keys: list[str], time: str, tracked: list[str] | None = None) -> DataFrame:
    """The whole history after changes that carry their own times, in whatever order they come.

    Each key's versions and changes are put in the order of their times. What differs from the one before it starts a
    version, which holds until the next one: several changes of a key in one batch make several versions, and a late one
    is spliced into the version that it falls in. What says nothing new leaves no trace, so a late change holds until the
    next version, also past times at which the old value was seen again. Of several at one time the last one given counts: a change before what the
    history has, of changes the one of the largest values. Changes without key or time are left out; replaying changes
    nothing. Keys without changes pass by; a set of tracked columns that differs from the history's is warned of.
    """
    if not keys:
        raise ValueError("a history needs keys")
    tracked, moved = tracking(target, changes, keys, tracked, (time,))
    kept = [c for c in changes.columns if c != time]
    own = hashed(changes.dropna(subset=[*keys, time]), tracked).select(*kept, HASH, F.col(time).cast("timestamp").alias(FROM), F.lit(1).alias("__new"))
    rest = None
    if target is not None:
        flag = own.select(*keys).distinct().withColumn("__met", F.lit(True))
        marked = target.join(flag, keys, "left")
        rest = marked.where("__met is null").drop("__met").select(*target.columns)
        old = marked.where("__met").drop("__met", TO, CURRENT).withColumn("__new", F.lit(0))
        old = hashed(old, tracked) if moved and set(tracked) <= set(old.columns) else old
        own = old.unionByName(own, allowMissingColumns=True)
    by_key = Window.partitionBy(*[F.col(f"`{k}`") for k in keys])
    values = [F.col(f"`{c}`").desc_nulls_last() for c in own.columns if c not in (*keys, FROM, "__new")]
    own = own.withColumn("__rn", F.row_number().over(by_key.partitionBy(*[F.col(f"`{k}`") for k in keys], FROM).orderBy(F.desc("__new"), *values))).where("__rn = 1")
    in_time = by_key.orderBy(FROM)
    differs = F.coalesce(F.lag(HASH).over(in_time) != F.col(HASH), F.lit(True))
    own = own.withColumn("__differs", differs).where("__differs").drop("__differs", "__rn", "__new")
    own = own.withColumn(TO, F.lead(FROM).over(in_time)).withColumn(CURRENT, F.col(TO).isNull())
    columns = [*kept, *(c for c in own.columns if c not in (*kept, HASH, FROM, TO, CURRENT)), HASH, FROM, TO, CURRENT]
    out = own.select(*columns)
    return told(out if rest is None else out.unionByName(rest, allowMissingColumns=True), tracked)


def scd2_stats(before: DataFrame | None, after: DataFrame, as_of) -> DataFrame:
    """inserted, expired and unchanged versions of the load of that time."""
    at = F.lit(as_of).cast("timestamp")
    return after.agg(
        F.count_if(F.col(FROM) == at).alias("inserted"),
        F.count_if(F.col(TO) == at).alias("expired"),
        F.count_if(F.col(CURRENT) & (F.col(FROM) != at)).alias("unchanged"),
    )


def scd2_as_of(history: DataFrame, at) -> DataFrame:
    """The rows as they were at a time."""
    t = F.lit(at).cast("timestamp")
    return history.where((F.col(FROM) <= t) & (F.col(TO).isNull() | (t < F.col(TO))))


def as_of_join(facts: DataFrame, history: DataFrame, keys: list[str], time: str, grain: str = "day") -> DataFrame:
    """Each fact with the version of its key that was true at the fact's time, or nulls.

    Facts and versions are laid side by side, and a fact takes the last version before it within its key and span of time
    (grain: day, month, ..., which bounds what one task sorts of a key). Spans without a version before the fact take the
    last one of the spans before, of which there is one row a key and span. So work grows with the rows, not with versions
    times facts of a key. Facts without key or time have no version. Of versions that start at one time the largest counts.
    """
    others = [c for c in history.columns if c not in (*keys, FROM, TO, CURRENT, HASH)]
    row = F.struct(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("v"), F.col(TO).alias("until"))
    key = lambda df: [F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]
    names = [f"k{i}" for i in range(len(keys))]
    versions = history.dropna(subset=[*keys, FROM]).select(*key(history), F.col(FROM).alias("t"), row.alias("version"))
    span = F.date_trunc(grain, "t").alias("span")
    whole = F.struct(*[F.col(f"`{c}`") for c in facts.columns]).alias("f")
    own = facts.select(*key(facts), F.col(f"`{time}`").cast("timestamp").alias("t"), whole)
    known = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in (*names, "t")])
    both = own.where(known).select("*", span).unionByName(versions.select("*", span), allowMissingColumns=True)
    before = Window.partitionBy(*names, "span").orderBy("t", F.col("f").isNotNull(), F.col("version").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("hit", F.last("version", ignorenulls=True).over(before)).where("f is not null").drop("version")
    last = versions.groupBy(*names, span).agg(F.max_by("version", F.struct("t", "version")).alias("last"))
    spans = last.unionByName(own.where(known).select(*names, span).distinct(), allowMissingColumns=True).groupBy(*names, "span").agg(F.first("last", ignorenulls=True).alias("last"))
    earlier = Window.partitionBy(*names).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("carried", F.last("last", ignorenulls=True).over(earlier)).select(*names, "span", "carried")
    found = met.join(carried, [*names, "span"], "left").withColumn("hit", F.coalesce("hit", "carried"))
    true_then = F.col("hit.until").isNull() | (F.col("t") < F.col("hit.until"))
    shown = lambda hit: [hit(i).alias(c if c not in facts.columns else f"as_of_{c}") for i, c in enumerate(others)]
    kinds = [history.schema[c].dataType for c in others]
    out = found.select("f.*", *shown(lambda i: F.when(true_then, F.col(f"hit.v.c{i}"))))
    lost = own.where(~known).select("f.*", *shown(lambda i: F.lit(None).cast(kinds[i])))
    return out.unionByName(lost)
