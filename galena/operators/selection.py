"""Exact quantiles by rounds of range histograms, for many groups and columns at once.

Each rank that is asked for has a range of values that holds it, at first that of its group. A round counts the values of
the range in BUCKETS equal parts, finds the part that holds the rank, and narrows the range to the least and largest value
of that part. A range of one value is the answer; ranges of FEW values are answered by sorting those. So no task holds the
values of a group, whatever its size, and the work of a round is one scan and BUCKETS counts a rank and task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.sources.folders import work_folder

BUCKETS, FEW = 1_024, 10_000
#: Rows of open ranks up to which they are broadcast to the values; beyond, both are shuffled by group.
MOST_BROADCAST = 20_000
INF = float("inf")


def _spread(x: Column) -> Column:
    """Values on a scale of magnitudes, for ranges that many orders of them lie in; rising with x."""
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log(F.abs(x)) + 745.0))


def _part(x: Column, low: Column, high: Column, by_size: bool) -> Column:
    """Which part of a range a value lies in; infinite values and NaN have parts of their own at the ends."""
    v, a, b = (_spread(x), _spread(low), _spread(high)) if by_size else (x / 2, low / 2, high / 2)
    inside = F.when(low == high, 0).otherwise(F.least(F.lit(BUCKETS - 1), F.greatest(F.lit(0), F.floor((v - a) / (b - a) * BUCKETS).cast("int"))))
    return F.when(F.isnan(x), BUCKETS + 1).when(x == INF, BUCKETS).when(x == -INF, -1).otherwise(inside)


def quantiles(df: DataFrame, keys: dict[str, Column], columns: dict[str, Column], shares: tuple[float, ...]) -> DataFrame:
    """A row for each group (keys by name, nulls being a group) and column with values: the keys, `of` (the column's name)
    and q0, q1, ... by linear interpolation, one for each share; as percentile() has them, NaN counting as largest."""
    names = list(keys)
    cells = F.array(*[F.struct(F.lit(c).alias("of"), x.cast("double").alias("x")) for c, x in columns.items()])
    values = df.select(*[k.alias(n) for n, k in keys.items()], F.inline(cells)).where("x is not null")
    group = [*names, "of"]
    spark, folder = df.sparkSession, None

    def kept(rows: DataFrame, step: str) -> DataFrame:
        """The rows computed once: a local table if they are few, else written and read again."""
        nonlocal folder
        some = rows.limit(MOST_BROADCAST + 1).collect()
        if len(some) <= MOST_BROADCAST:
            return spark.createDataFrame(some, rows.schema)
        folder = folder or work_folder(spark, "ranks")
        rows.write.parquet(f"{folder}/{step}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{step}")

    finite = F.when(~F.isnan("x") & (F.abs("x") < INF), F.col("x"))
    sizes = values.groupBy(*group).agg(F.count(F.lit(1)).alias("size"), F.min(finite).alias("low"), F.max(finite).alias("high"))
    totals = kept(sizes, "sizes")
    places = F.array(*[F.struct(F.lit(j).alias("j"), f(F.lit(p) * (F.col("size") - 1)).cast("bigint").alias("rank")) for j, p in enumerate(shares) for f in (F.floor, F.ceil)])
    ranks = totals.where("size > 0").select(*group, F.explode(F.array_distinct(F.transform(places, lambda p: p["rank"]))).alias("rank"), F.lit(0).cast("bigint").alias("below"), "size", "low", "high", F.lit(None).cast("double").alias("found"))

    def met(open_: DataFrame) -> DataFrame:
        few = open_.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST  # no job for a local table
        side = open_.toDF(*[f"r_{c}" for c in open_.columns])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in group])
        inside = F.when(F.isnan("x") | (F.abs("x") == INF), F.col("r_whole")).otherwise(F.col("x").between(F.col("r_low"), F.col("r_high")))
        return values.join(F.broadcast(side) if few else side, same & inside).select("x", *[F.col(f"r_{c}").alias(c) for c in open_.columns])

    done, step = None, 0
    while True:
        # A range is whole until its first round: only then do infinite values and NaN belong to it.
        open_ = ranks.where("found is null").withColumn("whole", F.lit(step == 0))
        state = open_.agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("most")).first()
        if not state.n:
            break
        if state.most <= FEW:
            sorted_ = met(open_).groupBy(*group, "rank", "below").agg(F.array_sort(F.collect_list("x")).alias("xs"))
            last = sorted_.select(*group, "rank", F.get("xs", (F.col("rank") - F.col("below")).cast("int")).alias("found"))
            done = last if done is None else done.unionByName(last)
            break
        ranges = open_.select(*group, "below", "low", "high", "whole").distinct()  # ranks of one range are counted once
        counted = met(ranges).withColumn("part", _part(F.col("x"), F.col("low"), F.col("high"), step % 2 == 1))
        counted = counted.groupBy(*group, "below", "part").agg(F.count(F.lit(1)).alias("size"), F.min("x").alias("low"), F.max("x").alias("high"))
        running = Window.partitionBy(*group, "below").orderBy("part")  # BUCKETS rows and a few
        upto = counted.withColumn("upto", F.col("below") + F.sum("size").over(running))
        asked = open_.select(*[F.col(c).alias(f"r_{c}") for c in group], F.col("below").alias("r_below"), "rank")
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in group])
        inside = (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("size"))
        chosen = upto.join(asked, same & (F.col("below") == F.col("r_below")) & inside)
        single = (F.col("low") == F.col("high")) | (F.col("part") > BUCKETS)
        step += 1
        ranks = kept(chosen.select(*group, "rank", (F.col("upto") - F.col("size")).alias("below"), "size", "low", "high", F.when(single, F.col("low")).alias("found")), f"ranks-{step}")
        told = ranks.where("found is not null").select(*group, "rank", "found")
        done = told if done is None else done.unionByName(told)
    if done is None:
        return spark.createDataFrame([], values.select(*group, *[F.col("x").alias(f"q{j}") for j in range(len(shares))]).schema)
    wanted = totals.select(*group, F.inline(F.transform(F.array(*[F.struct(F.lit(j).alias("j"), (F.lit(p) * (F.col("size") - 1)).alias("at")) for j, p in enumerate(shares)]), lambda s: s)))
    side = done.toDF(*[f"r_{c}" for c in group], "rank", "found")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in group])
    both = wanted.join(side, same & ((F.col("rank") == F.floor("at")) | (F.col("rank") == F.ceil("at"))))
    ends = both.groupBy(*group, "j", "at").agg(F.min_by("found", "rank").alias("a"), F.max_by("found", "rank").alias("b"))
    share = F.col("at") - F.floor("at")
    each = ends.select(*group, "j", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - share) * F.col("a") + share * F.col("b")).alias("q"))
    return each.groupBy(*group).agg(*[F.max(F.when(F.col("j") == j, F.col("q"))).alias(f"q{j}") for j in range(len(shares))])
