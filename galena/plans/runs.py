"""Runs of the three layers, their log, and how fresh what they leave is."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.operators import profile as P
from galena.operators import quality as Q
from galena.operators import refine as R
from galena.operators.ingest import load_bronze, read_bronze, read_state, save_state
from galena.operators.summarise import carry_gold, summarise
from galena.sources.readers import write_layer

STEP = "run_id string, dataset string, step string, status string, rows bigint, seconds double, note string"


class Breached(RuntimeError):
    """Too many rows were rejected."""


@dataclass(frozen=True)
class Dataset:
    """keys: with them, bronze is loaded incrementally: what is new is upserted by key. full: everything is read again."""

    name: str
    rows: DataFrame
    layer: str = "bronze"
    rules: tuple[Q.Rule, ...] | None = None
    keys: tuple[str, ...] = ()
    full: bool = False


def refine_silver(df: DataFrame, facts: list, rules, root: str, name: str, run_id: str, at, duplicates: float = 0.0) -> tuple[DataFrame, int]:
    """Quality on the rows as they came, quarantine of this run, the breach gate, then refinement of the clean rows.

    The evaluated rows are written once and read for the gate and both outputs.
    """
    path = write_layer(Q.evaluate(df, rules), root, "quarantine", f"{name}_evaluated")
    judged = df.sparkSession.read.parquet(path)
    gate = Q.breach(judged).first()
    write_layer(Q.quarantine(judged, run_id, at), root, "quarantine", f"{name}/run={run_id}")  # a run that comes again replaces its own
    if gate.breached:
        raise Breached(f"{gate.rejected} of {gate.total} rows were rejected")
    return R.refine(Q.clean(judged), R.plan_refine(facts, duplicates), at), gate.rejected


def run_medallion(datasets: list[Dataset], root: str, run_id: str, at) -> DataFrame:
    """Lands, refines and summarises each dataset; one that fails does not stop the others. Returns the step log.

    Datasets with keys load what is new since their last run; the state is kept beside the layers and moves after the write.
    """
    log, spark = [], datasets[0].rows.sparkSession

    def step(name: str, what: str, work):
        began = time.time()
        try:
            rows, note, out = work()
            log.append((run_id, name, what, "succeeded", rows, time.time() - began, note))
            return out
        except Exception as why:  # the log tells, and the other datasets go on
            log.append((run_id, name, what, "failed", None, time.time() - began, str(why)[:500]))
            return None

    for d in datasets:
        def land(d=d):
            if d.keys:
                loaded = load_bronze(d.rows, root, d.name, list(d.keys), read_state(spark, root), d.full)
                save_state(loaded["state"], root)
                out = read_bronze(spark, root, d.name)
                return out.count(), f"{loaded['mode']} of {loaded['rows_read']} rows: {loaded['reason']}", out
            out = spark.read.parquet(write_layer(d.rows, root, "bronze", d.name))
            return out.count(), None, out

        bronze = step(d.name, "bronze", land)
        if bronze is None:
            continue
        if d.layer == "gold":
            step(d.name, "gold", lambda d=d, b=bronze: (b.count(), "carried over", write_layer(carry_gold(b), root, "gold", d.name)))
            continue

        def silver(d=d, bronze=bronze):
            facts = P.profile(bronze).collect()
            repeated = P.duplicate_ratio(bronze).first().duplicate_ratio
            rules = d.rules if d.rules is not None else tuple(Q.default_policy(facts, P.key_candidates(bronze, facts)))
            out, rejected = refine_silver(bronze, facts, rules, root, d.name, run_id, at, repeated)
            out = spark.read.parquet(write_layer(out, root, "silver", d.name))
            return out.count(), f"{rejected} rows quarantined", out

        refined = step(d.name, "silver", silver)
        if refined is None:
            continue

        def gold(d=d, refined=refined):
            own = refined.drop(R.REFINED_AT)
            out = summarise(own, P.profile(own, details=False).collect())
            if out is None:
                return 0, "nothing to summarise", None
            out = spark.read.parquet(write_layer(out, root, "gold", d.name))
            return out.count(), None, out

        step(d.name, "gold", gold)
    return spark.createDataFrame(log, STEP)


def run_status(log: DataFrame) -> DataFrame:
    """run_id, status: failed if no step succeeded, partial if some did, else succeeded."""
    done, all_ = F.count_if(F.col("status") == "succeeded"), F.count(F.lit(1))
    return log.groupBy("run_id").agg(F.when(done == 0, "failed").when(done < all_, "partial").otherwise("succeeded").alias("status"))


def freshness(runs: DataFrame, schedules: DataFrame, as_of) -> DataFrame:
    """connection, finished_at, age_seconds, state (fresh, late, stale, unknown), reason.

    runs: connection, status, finished_at. schedules: connection, interval_seconds, enabled. Late beyond 1.5 intervals,
    stale beyond 2; a time in the future is no evidence. Ages are whole seconds that have passed.
    """
    at = F.lit(as_of).cast("timestamp")
    good = runs.where((F.col("status") == "succeeded") & F.col("finished_at").isNotNull())
    last = good.groupBy("connection").agg(F.max("finished_at").alias("finished_at"))
    own = schedules.select("connection", "interval_seconds", "enabled").join(last, "connection", "full")
    age = F.floor((F.unix_micros(at) - F.unix_micros("finished_at")) / 1_000_000)
    none = F.col("finished_at").isNull()
    planned = F.coalesce("enabled", F.lit(False)) & (F.col("interval_seconds") > 0)
    state = F.when(none | (age < 0) | ~F.coalesce(planned, F.lit(False)), "unknown").when(age > 2 * F.col("interval_seconds"), "stale").when(age > 1.5 * F.col("interval_seconds"), "late").otherwise("fresh")
    reason = F.when(none, "no run has succeeded").when(age < 0, "its last run lies in the future").when(F.col("interval_seconds").isNull(), "it has no schedule").when(~F.coalesce(planned, F.lit(False)), "its schedule is off").otherwise("by its schedule")
    return own.select("connection", "finished_at", age.alias("age_seconds"), state.alias("state"), reason.alias("reason"))
