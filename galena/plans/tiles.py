"""Dashboard tiles computed from metric queries."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.functions.failures import FAILURES, failure
from galena.plans.metrics import MOST_ROWS, Filter, MetricQuery, Model, Refused, join_path, metric_groups, metric_query

PERIODS = 60
KEEP = {"donut": 6, "bar": 8, "stacked": 8}


def stat_total(model: Model, measure: str, filters=()) -> DataFrame:
    """The headline: the measure over all rows, never a total of grouped values."""
    return metric_query(model, MetricQuery((measure,), filters=tuple(filters)))


def timeline(model: Model, measures, time: str, grain: str = "month", filters=()) -> DataFrame:
    """The measures by period, the latest PERIODS of them, oldest first."""
    query = MetricQuery(tuple(measures), time=time, grain=grain, filters=tuple(filters), limit=MOST_ROWS)
    name = f"{grain}_of_{time.partition('.')[2]}"
    late = metric_query(model, replace(query, order=((name, True),), limit=PERIODS))
    return late.orderBy(F.col(name).asc_nulls_first())


def period_series(model: Model, measure: str, time: str, grain: str = "month", filters=()) -> DataFrame:
    return timeline(model, (measure,), time, grain, filters)


def period_delta(model: Model, measure: str, time: str, grain: str = "month", filters=()) -> DataFrame:
    """The last period's value against the one before: value, previous, delta, delta_pct (null at 0), direction.

    The series has PERIODS rows at most, so its window is one small task.
    """
    series = period_series(model, measure, time, grain, filters)
    period = series.columns[0]
    by_time = Window.orderBy(F.col(period).asc_nulls_first())
    rows = series.withColumn("previous", F.lag(measure).over(by_time)).withColumn("rn", F.row_number().over(Window.orderBy(F.col(period).desc_nulls_last())))
    delta = F.col(measure) - F.col("previous")
    way = F.when(delta > 0, "up").when(delta < 0, "down").when(delta == 0, "flat")
    pct = F.try_divide(delta.cast("double"), F.abs("previous").cast("double"))
    return rows.where("rn = 1").select(period, F.col(measure).alias("value"), "previous", delta.alias("delta"), pct.alias("delta_pct"), way.alias("direction"))


def label(*columns: Column) -> Column:
    """Values as one label: null as "Not set", midnight as its date, several parts joined."""
    return F.concat_ws(" · ", *[F.regexp_replace(F.coalesce(c.cast("string"), F.lit("Not set")), " 00:00:00$", "") for c in columns])


def breakdown(model: Model, measures, dimensions, filters=(), limit: int = 12) -> DataFrame:
    """Measures by label, the largest first measure first."""
    out = metric_query(model, MetricQuery(tuple(measures), tuple(dimensions), filters=tuple(filters), limit=limit))
    dims = out.columns[: len(tuple(dimensions))]
    return out.select(label(*map(F.col, dims)).alias("label"), *measures)


def fold_tail(model: Model, measures, dimension: str, keep: int, filters=()) -> DataFrame:
    """The `keep` labels largest by the first measure's size, and all others as one "Other (n)".

    Labels are folded only when there are more than keep + 1. The rest is aggregated from the rows again, so averages
    and distinct counts of it are right; all groups are ranked and counted, so nothing is lost. Only the labels that
    are shown are broadcast.
    """
    measures = tuple(measures)
    _, attribute = model.attribute(dimension)
    if attribute.pii is not None:
        raise Refused(f"{dimension} is personal data")
    query = MetricQuery(measures, (dimension,), filters=tuple(filters), limit=keep + 1)
    groups, _ = metric_groups(model, query)
    groups = groups.select(F.col(groups.columns[0]).alias("__of"), F.abs(measures[0]).alias("size"))
    total = groups.agg(F.count(F.lit(1)).alias("__n"))
    by_size = [F.col("size").desc(), F.col("__of").asc_nulls_last()]
    ranked = groups.orderBy(*by_size).limit(keep + 1).withColumn("rn", F.row_number().over(Window.orderBy(*by_size)))
    shown = ranked.crossJoin(F.broadcast(total)).where((F.col("rn") <= keep) | (F.col("__n") <= keep + 1)).select("__of", label(F.col("__of")).alias("__label"))

    def fold(df: DataFrame, own: Column) -> tuple[DataFrame, Column]:
        both = df.join(F.broadcast(shown), own.eqNullSafe(F.col("__of")), "left").crossJoin(F.broadcast(total))
        rest = F.concat(F.lit("Other ("), (F.col("__n") - keep).cast("string"), F.lit(")"))
        return both, F.coalesce("__label", rest)

    out = metric_query(model, query, fold)
    return out.withColumnRenamed(out.columns[0], "label")


def share(model: Model, measure: str, dimension: str, keep: int = KEEP["donut"], filters=()) -> DataFrame:
    """A donut: folded labels with their share of the total."""
    rows = fold_tail(model, (measure,), dimension, keep, filters)
    total = F.sum(F.col(measure).cast("double")).over(Window.partitionBy())
    return rows.withColumn("share", F.try_divide(F.col(measure).cast("double"), total))


def detail(model: Model, measures, dimension: str, time: str, grain: str = "month", filters=(), limit: int = 200) -> DataFrame:
    return metric_query(model, MetricQuery(tuple(measures)[:4], (dimension,), time, grain, tuple(filters), limit=limit))


def scatter(model: Model, measures, dimension: str, filters=(), limit: int = 200) -> DataFrame:
    if len(tuple(measures)) != 2:
        raise Refused("a scatter takes two measures")
    return breakdown(model, measures, (dimension,), filters, limit)


def cross_filter(filters: tuple[Filter, ...], field: str, value) -> tuple[Filter, ...]:
    """The filters after a click: equality on the field is set to the value, or taken off if it was there."""
    rest = tuple(f for f in filters if not (f.field == field and f.op == "eq"))
    return rest if Filter(field, "eq", value) in filters else (*rest, Filter(field, "eq", value))


@dataclass(frozen=True)
class Tile:
    """kind: one of SHAPES. A stat with a time has the latest period and its series beside the total."""

    name: str
    kind: str
    measures: tuple[str, ...]
    dimension: str | None = None
    time: str | None = None
    grain: str = "month"
    filters: tuple[Filter, ...] = ()


#: What each kind of tile takes: measures at least and at most, and what it runs along.
SHAPES = {
    "stat": (1, 1, ()), "delta": (1, 1, ("time",)), "line": (1, 1, ("time",)), "area": (1, 1, ("time",)), "combo": (2, 8, ("time",)),
    "bar": (1, 8, ("dimension",)), "stacked": (1, 8, ("dimension",)), "donut": (1, 1, ("dimension",)), "scatter": (2, 2, ("dimension",)), "detail": (1, 4, ("dimension", "time")),
}


def shape_problems(tile: Tile) -> list[str]:
    """Why a tile cannot be drawn as it is asked for, all reasons; none if it can."""
    if tile.kind not in SHAPES:
        return [f"no kind of tile {tile.kind}"]
    least, most, along = SHAPES[tile.kind]
    n = len(tile.measures)
    out = [] if least <= n <= most else [f"a {tile.kind} takes {least if least == most else f'{least} to {most}'} measures, not {n}"]
    return out + [f"a {tile.kind} needs a {what}" for what in along if getattr(tile, what) is None]


def run_tile(model: Model, tile: Tile, filters=()) -> DataFrame:
    """The rows of one tile by itself. Refused if it cannot be drawn."""
    if problems := shape_problems(tile):
        raise Refused("; ".join(problems))
    own = (*tile.filters, *filters)
    first = tile.measures[0]
    if tile.kind == "stat":
        return stats_of(model, tile, filters) if tile.time else stat_total(model, first, own)
    if tile.kind == "delta":
        return period_delta(model, first, tile.time, tile.grain, own)
    if tile.kind in ("line", "area", "combo"):
        return timeline(model, tile.measures, tile.time, tile.grain, own)
    if tile.kind in ("bar", "stacked"):
        return fold_tail(model, tile.measures, tile.dimension, KEEP[tile.kind], own)
    if tile.kind == "donut":
        return share(model, first, tile.dimension, filters=own)
    if tile.kind == "scatter":
        return scatter(model, tile.measures, tile.dimension, own)
    return detail(model, tile.measures, tile.dimension, tile.time, tile.grain, own)


def told(why: Exception) -> str:
    return str(why) if isinstance(why, Refused) else failure(why)


def run_dashboard(model: Model, tiles, filters=()) -> dict[str, DataFrame | str]:
    """Each tile's rows as a plan of its own, or why it has none: a tile that cannot be planned does not stop the others."""
    out: dict[str, DataFrame | str] = {}
    for t in tiles:
        try:
            out[t.name] = run_tile(model, t, filters)
        except (Refused, *FAILURES) as why:
            out[t.name] = told(why)
    return out


def stats_of(model: Model, tile: Tile, filters=(), shown: int = 12) -> DataFrame:
    """A stat with what stands beside it: value, previous period, delta, direction, and the latest periods as a series."""
    first, own = tile.measures[0], (*tile.filters, *filters)
    total = stat_total(model, first, own).select(F.col(first).alias("total"))
    if not tile.time:
        return total
    line = timeline(model, (first,), tile.time, tile.grain, own)
    period = line.columns[0]
    series = line.orderBy(F.col(period).desc_nulls_last()).limit(shown)
    listed = series.agg(F.array_sort(F.collect_list(F.struct(F.col(period).alias("period"), F.col(first).alias("value")))).alias("series"))
    delta = period_delta(model, first, tile.time, tile.grain, own).select("value", "previous", "delta", "delta_pct", "direction")
    return total.join(F.broadcast(delta), F.lit(True), "left").crossJoin(F.broadcast(listed))  # one row each, delta none without periods


def reached(model: Model, entity: str, path: str) -> bool:
    """Whether the entity's measures can be shown by a field."""
    try:
        join_path(model, entity, {path.partition(".")[0]} - {entity})
    except Refused:
        return False
    return True


def overview(model: Model, entity: str, time: str | None, cardinality: dict[str, int]) -> list[Tile]:
    """The default tiles of a fact: up to 4 stats, a trend, up to 3 breakdowns, a donut, a combo and a detail table.

    cardinality: distinct values by field; fields with 2 to 24 values that are neither hidden nor personal are used, the
    fact's own first.
    """
    measures = [m.name for m in model.measures if m.entity == entity]
    usable = lambda a: not a.hidden and a.pii is None
    fields = [f"{e.name}.{a.name}" for e in sorted(model.entities, key=lambda e: e.name != entity) for a in e.attributes if usable(a)]
    dims = [f for f in fields if 2 <= cardinality.get(f, 0) <= 24 and f != time and reached(model, entity, f)]
    out = [Tile(f"total {m}", "stat", (m,), time=time) for m in measures[:4]]
    if time:
        out.append(Tile("trend", "line", (measures[0],), time=time))
    out += [Tile(f"by {d}", "bar", (measures[0],), d) for d in dims[:3]]
    out += [Tile("share", "donut", (measures[0],), d) for d in dims if cardinality[d] <= 6][:1]
    kinds = {m.name: m.format for m in model.measures}
    other = next((m for m in measures[1:] if kinds[m] != kinds[measures[0]]), None)
    if time and other:
        out.append(Tile("combo", "combo", (measures[0], other), time=time))
    if time and dims:
        out.append(Tile("detail", "detail", tuple(measures[:4]), dims[0], time))
    return out


# What speaks for a table as the one to give an overview of.
FACT_WEIGHTS = {"time": 4, "hub": 3, "most_for_size": 3, "measure": 0.4, "most_for_measures": 2}


def choose_fact(model: Model, rows: dict[str, int], times: dict[str, str | None]) -> str:
    """The entity to give an overview of: one with a time, others around it, many rows and measures."""
    def score(name: str) -> float:
        hub = any(j.left == name for j in model.joins)
        measures = sum(m.entity == name for m in model.measures)
        w = FACT_WEIGHTS
        size = min(w["most_for_size"], math.log10(max(1, rows.get(name, 1))))
        return w["time"] * bool(times.get(name)) + w["hub"] * hub + size + min(w["most_for_measures"], w["measure"] * measures)

    with_measures = [e.name for e in model.entities if any(m.entity == e.name for m in model.measures)]
    if not with_measures:
        raise Refused("no entity has measures")
    return max(sorted(with_measures), key=score)


def about_tiles(spark, model: Model, tiles, filters=()) -> DataFrame:
    """tile, kind, measure, definition, dimension, filters: what each number on a page means."""
    told = lambda fs: "; ".join(f"{f.field} {f.op} {f.value}" if f.value is not None else f"{f.field} {f.op}" for f in fs)
    rows = []
    for t in tiles:
        for name in t.measures:
            m = next((m for m in model.measures if m.name == name), None)
            what = f"{m.agg}({m.entity}.{m.column or '*'})" + (f" where {told([m.constraint])}" if m.constraint else "") if m else "unknown"
            rows.append((t.name, t.kind, name, what, t.dimension or t.time, told((*t.filters, *filters))))
    return spark.createDataFrame(rows, "tile string, kind string, measure string, definition string, by string, filters string")


def export_tiles(tiles: dict[str, DataFrame | str], about: DataFrame, path: str) -> None:
    """Each tile's rows as csv below path, and a table of what they mean (see about_tiles)."""
    for name, rows in tiles.items():
        if not isinstance(rows, str):
            rows.write.mode("overwrite").csv(f"{path}/{name.replace(' ', '_')}", header=True)
    about.write.mode("overwrite").csv(f"{path}/about", header=True)
