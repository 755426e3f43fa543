"""A page of tiles from one aggregate.

The tiles of a page that stand on the same fact and filters share one job: the joined rows are aggregated at GROUPING SETS,
one set for each combination of dimensions and time that a tile needs and none beside. So averages and distinct
counts come from the rows, as in a query of their own, and a set has as many groups as its tile, not the product of all
tiles' dimensions. A second job takes each tile's leading groups, a third, if any tile has more labels than it shows, merges
the rest of them from states (sums and counts). What is collected is bounded by what the tiles show.
"""

from __future__ import annotations

import math
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from galena.functions.failures import FAILURES
from galena.functions.masks import mask_kind
from galena.functions.types import TEMPORAL, logical_type
from galena.plans.metrics import GRAINS, Measure, Model, Refused, aggregate, output_name, qualified, rows_of
from galena.plans.tiles import KEEP, PERIODS, Tile, choose_fact, label, overview, run_tile, shape_problems, told

#: Measures whose groups cannot be merged: a tile of many labels that has one is computed by itself.
WHOLE = ("count_distinct", "median")
SHOWN, SPARK_LINE = 200, 12


@dataclass(frozen=True)
class Need:
    """Groups of a tile: by which fields (a time as (field, grain)), in what order, and how many."""

    tile: Tile
    fields: tuple[object, ...]
    order: str  # "time", "size" or "value"
    most: int


def needs_of(tile: Tile) -> list[Need]:
    """What a tile shows of the groups of a page; one group more than is shown tells that there are more."""
    at = (tile.time, tile.grain)
    if tile.kind == "stat":
        return [Need(tile, (), "value", 1), *([Need(tile, (at,), "time", PERIODS)] if tile.time else [])]
    if tile.kind in ("delta", "line", "area", "combo"):
        return [Need(tile, (at,), "time", PERIODS)]
    if tile.kind in ("bar", "stacked", "donut"):
        return [Need(tile, (tile.dimension,), "size", KEEP[tile.kind] + 2)]
    return [Need(tile, (tile.dimension,) if tile.kind == "scatter" else (at, tile.dimension), "value", SHOWN)]


@dataclass
class Groups:
    """The groups of some tiles: kept rows of (set, k0.. keys, m0.. measures, s, c states of averages)."""

    rows: DataFrame
    fields: list[object]
    measures: list[Measure]
    needs: list[Need]
    sets: dict[tuple[object, ...], int]


def grouped(model: Model, tiles: list[Tile], filters) -> Groups:
    """The plan of one aggregate for tiles of one fact and with the same filters of their own."""
    needs = [n for t in tiles for n in needs_of(t)]
    fields = list(dict.fromkeys(f for n in needs for f in n.fields))
    measures = [model.measure(m) for m in dict.fromkeys(m for t in tiles for m in t.measures)]
    fact = measures[0].entity
    paths = [f if isinstance(f, str) else f[0] for f in fields]
    df, used, hidden = rows_of(model, fact, paths, (*tiles[0].filters, *filters))
    keys = []
    for i, f in enumerate(fields):
        entity, attribute = used[paths[i]]
        own = qualified(entity.name, attribute.source)
        if isinstance(f, str):
            own = mask_kind(own, attribute.pii) if hidden(attribute) else own
        else:
            own = F.date_trunc(f[1], own)
        keys.append(own.alias(f"k{i}"))
    inputs = list(dict.fromkeys(c for m in measures for c in (m.column, m.constraint and m.constraint.field) if c))
    values = [qualified(fact, c).alias(f"v{i}") for i, c in enumerate(inputs)]
    own = df.select(*keys, *values) if keys or values else df.select(F.lit(1).alias("v"))
    column = lambda c: F.col(f"v{inputs.index(c)}")
    made = [aggregate(m, column).alias(f"m{i}") for i, m in enumerate(measures)]
    for i, m in enumerate(measures):
        if m.agg == "avg":
            part = lambda agg, m=m: aggregate(Measure(m.name, m.entity, agg, m.column, m.constraint), column)
            made += [part("sum").alias(f"s{i}"), part("count").alias(f"c{i}")]
    names = [f"k{i}" for i in range(len(fields))]
    wanted = list(dict.fromkeys(tuple(n.fields) for n in needs))
    mask = lambda fs: sum(1 << (len(fields) - 1 - i) for i, f in enumerate(fields) if f not in fs)
    if names:
        sets = [[names[fields.index(f)] for f in fs] for fs in wanted]
        rows = own.groupingSets(sets, *names).agg(F.grouping_id().cast("bigint").alias("set"), *made)
    else:
        rows = own.agg(*made).withColumn("set", F.lit(0).cast("bigint"))
    return Groups(rows, fields, measures, needs, {fs: mask(fs) for fs in wanted})


def leading(g: Groups) -> list[Row]:
    """The groups that each need shows, by need and rank. Partial ranks leave each task with SHOWN rows a need at most."""
    by_set = defaultdict(list)
    for i, n in enumerate(g.needs):
        by_set[g.sets[tuple(n.fields)]].append(i)
    chosen = reduce(lambda c, item: c.when(F.col("set") == item[0], F.array(*map(F.lit, item[1]))), by_set.items(), F)
    orders: dict[str, list[int]] = defaultdict(list)
    for i, n in enumerate(g.needs):
        if n.fields:
            orders[order_of(g, n)].append(i)
    first = [F.expr(how) for how in orders]
    ranked = [F.when(F.col("need").isin(who), how).desc_nulls_last() for how, who in zip(first, orders.values(), strict=True)]
    ties = [F.col(f"k{i}").asc_nulls_last() for i in range(len(g.fields))]
    rank = F.row_number().over(Window.partitionBy("need").orderBy(*ranked, *(ties or [F.lit(1)])))
    texts = [label(F.col(f"k{i}")).alias(f"l{i}") for i in range(len(g.fields))]
    out = g.rows.withColumn("need", F.explode(chosen)).withColumn("rank", rank).where(F.col("rank") <= SHOWN)
    return sorted(out.select("*", *texts).collect(), key=lambda r: (r.need, r["rank"]))


def order_of(g: Groups, n: Need) -> str:
    if n.order == "time":
        return f"k{g.fields.index(n.fields[0])}"
    own = f"m{[m.name for m in g.measures].index(n.tile.measures[0])}"
    return f"abs({own})" if n.order == "size" else own


def merged(m: Measure, i: int, kept: Column) -> Column:
    """A measure over the groups that are kept."""
    own = lambda name: F.when(kept, F.col(f"{name}{i}"))
    if m.agg == "avg":
        return F.try_divide(F.sum(own("s")), F.sum(own("c")))
    return {"min": F.min, "max": F.max}.get(m.agg, F.sum)(own("m"))


def tails(g: Groups, folds: dict[int, list[Row]]) -> dict[int, Row]:
    """For each need the number of groups that are not shown and their measures; one row for all of them."""
    kinds = {f.name: f.dataType for f in g.rows.schema.fields}
    made = []
    for i, shown in folds.items():
        n = g.needs[i]
        k = f"k{g.fields.index(n.fields[0])}"
        same = reduce(lambda c, r: c | F.col(k).eqNullSafe(F.lit(r[k]).cast(kinds[k])), shown, F.lit(False))
        rest = (F.col("set") == g.sets[tuple(n.fields)]) & ~same
        values = [merged(m, j, rest).cast(kinds[f"m{j}"]).alias(f"m{j}") for j, m in enumerate(g.measures) if m.name in n.tile.measures]
        made.append(F.struct(F.count_if(rest).alias("n"), *values).alias(f"t{i}"))
    row = g.rows.agg(*made).first()
    return {i: row[f"t{i}"] for i in folds}


def descending(value) -> tuple:
    """A key that puts the largest first, NaN before it and None last, as Spark orders."""
    return (value is None, not (isinstance(value, float) and math.isnan(value)), 0 if value is None or value != value else -value)


def overall(model: Model, rows: list[Row], tile: Tile, own: list[str]) -> list:
    """The measures over all rows. Grouping sets have no group of no rows, where counts are 0 and all else is null."""
    none = lambda m: 0 if model.measure(m).agg in ("count", "count_distinct", "total") else None
    return [rows[0][m] for m in own] if rows else [none(m) for m in tile.measures]


def change(line: list[tuple]) -> dict:
    """The last of (period, value) against the one before it."""
    if not line:
        return dict.fromkeys(("value", "previous", "delta", "delta_pct", "direction"))
    value, before = line[-1][1], line[-2][1] if len(line) > 1 else None
    delta = None if value is None or before is None else value - before
    way = None if delta is None else "up" if delta > 0 else "down" if delta < 0 else "flat"
    return {"value": value, "previous": before, "delta": delta, "delta_pct": float(delta) / abs(float(before)) if delta is not None and before else None, "direction": way}


def shaped(model: Model, g: Groups, tile: Tile, found: dict[int, list[Row]], rest: dict[int, Row]) -> list[Row]:
    """A tile's rows as run_tile() has them."""
    at = [i for i, n in enumerate(g.needs) if n.tile is tile]
    where = {m.name: f"m{j}" for j, m in enumerate(g.measures)}
    own = [where[m] for m in tile.measures]
    n = g.needs[at[-1]]
    rows = found.get(at[-1], [])[: n.most]
    names = lambda *keys: Row(*keys, *tile.measures)
    if n.order == "time":
        key = f"k{g.fields.index(n.fields[0])}"
        line = sorted(((r[key], *(r[m] for m in own)) for r in rows), key=lambda r: (r[0] is not None, r[0]))
        period = f"{tile.grain}_of_{model.attribute(tile.time)[1].name}"
        if tile.kind == "stat":
            return [Row(total=overall(model, found[at[0]], tile, own)[0], **change(line), series=[Row(period=p, value=v) for p, v in line[-SPARK_LINE:]])]
        if tile.kind == "delta":
            return [Row(**{period: line[-1][0]}, **change(line))] if line else []
        return [names(period)(*r) for r in line]
    if not n.fields:
        return [names()(*overall(model, rows, tile, own))]
    if tile.kind == "detail":
        keys = [f"k{g.fields.index(f)}" for f in n.fields]
        period = f"{tile.grain}_of_{model.attribute(tile.time)[1].name}"
        return [names(period, output_name(model, *model.attribute(tile.dimension)))(*(r[k] for k in keys), *(r[m] for m in own)) for r in rows]
    text = f"l{g.fields.index(n.fields[0])}"
    out = [(r[text], *(r[m] for m in own)) for r in rows]
    if n.order == "size":
        keep = n.most - 2
        if at[-1] in rest:
            out = [*out[:keep], (f"Other ({rest[at[-1]]['n']})", *(rest[at[-1]][m] for m in own))]
        out = sorted(out, key=lambda r: (*descending(r[1]), r[0]))
    if tile.kind == "donut":
        total = sum(float(v) for _, v in out if v is not None)
        return [Row("label", tile.measures[0], "share")(t, v, None if v is None or not total else float(v) / total) for t, v in out]
    return [names("label")(*r) for r in out]


def answered(model: Model, tiles: list[Tile], filters) -> dict[str, list[Row]]:
    """All tiles of one fact and filter by their shared aggregate."""
    g = grouped(model, tiles, filters)
    g.rows = g.rows.persist()
    try:
        found = defaultdict(list)
        for r in leading(g):
            found[r.need].append(r)
        folds = {i: found[i][: n.most - 2] for i, n in enumerate(g.needs) if n.order == "size" and len(found[i]) >= n.most}
        alone = {g.needs[i].tile for i in folds if any(model.measure(m).agg in WHOLE for m in g.needs[i].tile.measures)}
        folds = {i: rows for i, rows in folds.items() if g.needs[i].tile not in alone}
        rest = tails(g, folds) if folds else {}
        out = {t.name: shaped(model, g, t, found, rest) for t in tiles if t not in alone}
    finally:
        g.rows.unpersist()
    return out | {t.name: run_tile(model, t, filters).collect() for t in alone}


def checked(model: Model, tile: Tile) -> str:
    """The fact of a tile that can be drawn. Refused if it cannot."""
    if problems := shape_problems(tile):
        raise Refused("; ".join(problems))
    facts = {model.measure(m).entity for m in tile.measures}
    if len(facts) > 1:
        raise Refused("measures of two entities")
    if tile.grain not in GRAINS:
        raise Refused(f"no grain {tile.grain}")
    if tile.kind in ("bar", "stacked", "donut") and model.attribute(tile.dimension)[1].pii is not None:
        raise Refused(f"{tile.dimension} is personal data")
    return facts.pop()


def collect_page(model: Model, tiles, filters=(), at_once: int = 8) -> dict[str, list[Row] | str]:
    """The rows of each tile, or why it has none: what goes wrong with a tile, in planning or running, stays with it.

    Tiles of one fact and with the same filters share an aggregate. If that fails, each of them is computed by itself, so
    that one wrong measure does not stop the others. Shared aggregates run side by side.
    """
    out: dict[str, list[Row] | str] = {}
    shares: dict[tuple, list[Tile]] = defaultdict(list)
    for i, t in enumerate(tiles):
        try:
            aggs = {model.measure(m).agg for m in t.measures}
            # Distinct counts go together, as they are not wanted at the sets of others; a median is selected by itself.
            shares[checked(model, t), t.filters, i if "median" in aggs else -1 if "count_distinct" in aggs else None].append(t)
        except Refused as why:
            out[t.name] = told(why)

    def alone(t: Tile) -> list[Row] | str:
        try:
            return run_tile(model, t, filters).collect()
        except (Refused, *FAILURES) as why:
            return told(why)

    def together(some: list[Tile]) -> dict[str, list[Row] | str]:
        if any(model.measure(m).agg == "median" for m in some[0].measures):
            return {some[0].name: alone(some[0])}
        try:
            return answered(model, some, filters)
        except (Refused, *FAILURES) as why:
            if len(some) == 1:
                return {some[0].name: told(why)}
        with ThreadPoolExecutor(max_workers=at_once) as pool:
            return dict(zip([t.name for t in some], pool.map(alone, some), strict=True))

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        for rows in pool.map(together, shares.values()):
            out |= rows
    return {t.name: out[t.name] for t in tiles}


POINTS = "tile string, position int, label string, measure string, value double, problem string"


def page_points(spark: SparkSession, model: Model, tiles, filters=()) -> DataFrame:
    """A page as rows: for each tile, in order, its labels and measures, one value a row; for a tile without rows its
    problem. The parts of a stat beside its total (value, previous, delta, delta_pct) are measures of their own."""
    rows = []
    for name, found in collect_page(model, tiles, filters).items():
        if isinstance(found, str):
            rows.append((name, 0, None, None, None, found))
            continue
        tile = next(t for t in tiles if t.name == name)
        for i, r in enumerate(found):
            values = {m: v for m, v in r.asDict().items() if m in tile.measures or m in ("total", "value", "previous", "delta", "delta_pct", "share")}
            keys = [v for m, v in r.asDict().items() if m not in values and m not in ("series", "direction")]
            text = " · ".join("Not set" if k is None else str(k).removesuffix(" 00:00:00") for k in keys) if keys else None
            rows += [(name, i, text, m, None if v is None else float(v), None) for m, v in values.items()]
    return spark.createDataFrame(rows, POINTS)


def default_page(model: Model, fact: str | None = None) -> list[Tile]:
    """The overview of the model's leading fact, or of the one given: which it is, its time, and which fields have few
    values is counted, one job a table."""

    def counted(entity) -> tuple[str, int, str | None, dict[str, int]]:
        kinds = {f.name: logical_type(f.dataType) for f in entity.table.schema.fields}
        shown = [a for a in entity.attributes if not a.hidden and a.pii is None and kinds.get(a.source) not in (None, "json", "binary")]
        time = next((f"{entity.name}.{a.name}" for a in shown if kinds[a.source] in TEMPORAL), None)
        # A set of values is given up beyond 25 of them by sketch; up to there it is counted exactly.
        sketch = entity.table.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(f"`{a.source}`").alias(f"d{i}") for i, a in enumerate(shown)]).first()
        few = [(i, a) for i, a in enumerate(shown) if sketch[f"d{i}"] <= 32]
        sets = entity.table.agg(*[F.size(F.collect_set(f"`{a.source}`")).alias(f"d{i}") for i, a in few]).first() if few else {}
        return entity.name, sketch.n, time, {f"{entity.name}.{a.name}": sets[f"d{i}"] for i, a in few}

    with ThreadPoolExecutor(max_workers=8) as pool:
        facts = list(pool.map(counted, model.entities))
    times = {name: time for name, _, time, _ in facts}
    fact = fact or choose_fact(model, {name: n for name, n, _, _ in facts}, times)
    cardinality = {f: n for *_, few in facts for f, n in few.items()}
    return overview(model, fact, times[fact], cardinality)

