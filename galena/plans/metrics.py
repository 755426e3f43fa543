"""Governed metric queries over a semantic model: a plan is built, or refused before any job runs."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.functions.masks import STRATEGIES, mask_kind
from galena.operators.selection import quantiles

GRAINS = ("day", "week", "month", "quarter", "year")
MOST_ROWS, DEFAULT_ROWS, MOST_VALUES = 50_000, 500, 1_000


class Refused(ValueError):
    """The query cannot be answered correctly."""


@dataclass(frozen=True)
class Attribute:
    name: str
    column: str | None = None
    pii: str | None = None
    hidden: bool = False

    @property
    def source(self) -> str:
        return self.column or self.name


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: object = None


@dataclass(frozen=True)
class Measure:
    """agg: sum, avg, min, max, count, count_distinct, median, total (a sum, 0 if there is nothing to sum). column None: rows are counted. constraint: a filter on
    the entity's own columns that applies inside the aggregate only."""

    name: str
    entity: str
    agg: str
    column: str | None = None
    constraint: Filter | None = None
    format: str = "number"


@dataclass(frozen=True)
class Entity:
    name: str
    table: DataFrame
    attributes: tuple[Attribute, ...]


@dataclass(frozen=True)
class Join:
    """kind: many_to_one or one_to_one, from `left` to `right`. unique: whether right has each key once, where that is known
    (a profile tells); else it is counted when a query first takes the join."""

    left: str
    right: str
    on: tuple[tuple[str, str], ...]
    kind: str = "many_to_one"
    unique: bool | None = None


@dataclass(frozen=True)
class Model:
    entities: tuple[Entity, ...]
    measures: tuple[Measure, ...]
    joins: tuple[Join, ...] = ()
    #: What was counted of joins: (entity, key columns) → whether each key is there once. Tables are fixed once they are
    #: read, so it holds as long as the model.
    counted: dict[tuple[str, tuple[str, ...]], bool] = field(default_factory=dict, compare=False, repr=False)

    def entity(self, name: str) -> Entity:
        return self._one(self.entities, name, "entity")

    def measure(self, name: str) -> Measure:
        return self._one(self.measures, name, "measure")

    def attribute(self, path: str) -> tuple[Entity, Attribute]:
        entity, dot, name = path.partition(".")
        if not dot:
            raise Refused(f"{path}: a field is named entity.attribute")
        own = self.entity(entity)
        return own, self._one(own.attributes, name, f"attribute of {entity}")

    @staticmethod
    def _one(things, name, what):
        for x in things:
            if x.name == name:
                return x
        raise Refused(f"no {what} {name}")


@dataclass(frozen=True)
class MetricQuery:
    measures: tuple[str, ...]
    dimensions: tuple[str, ...] = ()
    time: str | None = None
    grain: str = "month"
    filters: tuple[Filter, ...] = ()
    order: tuple[tuple[str, bool], ...] = ()  # (output column or measure, descending)
    limit: int = DEFAULT_ROWS
    #: Kinds of personal data that may be seen as they are.
    permissions: frozenset[str] = field(default_factory=frozenset)


def _listed(value) -> list:
    out = list(value) if isinstance(value, (list, tuple, set)) else [value]
    if not out:
        raise Refused("an empty list of values")
    return out


def _two(value) -> tuple:
    if not isinstance(value, (list, tuple)) or len(value) != 2:
        raise Refused("between takes two values")
    return tuple(value)


#: Operators of filters. Values are literals, so nothing in them is read as SQL or as a pattern.
OPERATORS: dict[str, Callable[[Column, object], Column]] = {
    "eq": lambda c, v: c == F.lit(v),
    "ne": lambda c, v: c != F.lit(v),
    "gt": lambda c, v: c > F.lit(v),
    "gte": lambda c, v: c >= F.lit(v),
    "lt": lambda c, v: c < F.lit(v),
    "lte": lambda c, v: c <= F.lit(v),
    "in": lambda c, v: c.isin(_listed(v)),
    "not_in": lambda c, v: ~c.isin(_listed(v)),
    "contains": lambda c, v: F.contains(c.cast("string"), F.lit(str(v))),
    "starts_with": lambda c, v: F.startswith(c.cast("string"), F.lit(str(v))),
    "between": lambda c, v: c.between(*_two(v)),
    "is_null": lambda c, v: c.isNull(),
    "is_not_null": lambda c, v: c.isNotNull(),
}


def predicate(column: Column, f: Filter) -> Column:
    if f.op not in OPERATORS:
        raise Refused(f"no operator {f.op}")
    if f.value is None and f.op not in ("is_null", "is_not_null"):
        raise Refused(f"{f.op} takes a value")
    return OPERATORS[f.op](column, f.value)


def aggregate(m: Measure, column: Callable[[str], Column]) -> Column:
    """The measure over the entity's columns, which `column` gives by name."""
    kept = predicate(column(m.constraint.field), m.constraint) if m.constraint else None
    if m.agg == "count" and m.column is None:
        return F.count(F.lit(1)) if kept is None else F.count_if(kept)
    kinds = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "count_distinct": F.count_distinct, "median": F.median, "total": lambda c: F.coalesce(F.sum(c), F.lit(0))}
    if m.agg not in kinds or m.column is None:
        raise Refused(f"{m.name}: {m.agg} is not an aggregation that can be computed")
    own = column(m.column)
    return kinds[m.agg](own if kept is None else F.when(kept, own))


def join_path(model: Model, base: str, wanted: set[str]) -> list[Join]:
    """The joins that lead from base to the wanted entities, nearest first, none of which multiplies rows."""
    came: dict[str, tuple[str, Join] | None] = {base: None}
    todo = deque([base])
    while todo:
        at = todo.popleft()
        for j in model.joins:
            ways = [(j.left, j.right, j)] if j.kind in ("many_to_one", "one_to_one") else []
            if j.kind == "one_to_one":
                ways.append((j.right, j.left, replace(j, left=j.right, right=j.left, on=tuple((b, a) for a, b in j.on))))
            for start, end, step in ways:
                if start == at and end not in came:
                    came[end] = (at, step)
                    todo.append(end)
    out: list[Join] = []
    for name in came:  # breadth first
        if name in wanted:
            path, at = [], name
            while came[at] is not None:
                at, step = came[at]
                path.append(step)
            out += [s for s in reversed(path) if s not in out]
    if lost := wanted - came.keys():
        raise Refused(f"{', '.join(sorted(lost))} cannot be reached from {base} without multiplying its rows")
    return out


def multiplying(model: Model, joins: list[Join]) -> list[Join]:
    """Those of the joins whose right side has a key more than once. What is not known yet is counted in one job over the
    keys of all of them, and remembered by the model. Null keys meet no row, so they may repeat."""
    ends = lambda j: (j.right, tuple(b for _, b in j.on))
    model.counted.update({ends(j): j.unique for j in joins if j.unique is not None})
    todo = sorted({ends(j) for j in joins} - model.counted.keys())
    if todo:
        found = []
        for i, (name, columns) in enumerate(todo):
            keys = [F.col(f"`{c}`") for c in columns]
            again = model.entity(name).table.select(*keys).dropna().groupBy(*keys).count().where("count > 1")
            found.append(again.select(F.lit(i).alias("i")).limit(1))
        twice = {r.i for r in reduce(DataFrame.unionByName, found).collect()}
        model.counted.update({end: i not in twice for i, end in enumerate(todo)})
    return [j for j in joins if not model.counted[ends(j)]]


def output_name(model: Model, entity: Entity, attribute: Attribute) -> str:
    """A dimension's column: the attribute's name, with the entity before it where several entities have it."""
    shared = sum(a.name == attribute.name for e in model.entities for a in e.attributes) > 1
    return f"{entity.name}_{attribute.name}" if shared else attribute.name


def qualified(entity: str, column: str) -> Column:
    return F.col(f"{entity}.{column}")


def rows_of(model: Model, base: str, fields, filters=(), permissions=frozenset()) -> tuple[DataFrame, dict[str, tuple[Entity, Attribute]], Callable[[Attribute], bool]]:
    """The rows of an entity, joined with those that fields and filters name and filtered; what each field is; and which
    attributes are to be masked. Columns are qualified by entity. Refused where a join would multiply rows."""
    used = {f: model.attribute(f) for f in [*fields, *(f.field for f in filters)]}
    joins = join_path(model, base, {e.name for e, _ in used.values()} - {base})
    hidden = lambda a: a.pii is not None and a.pii not in permissions
    if masked := [f.field for f in filters if hidden(used[f.field][1])]:
        raise Refused(f"{masked[0]} is masked, and a filter would tell its values")
    kept = [predicate(qualified(used[f.field][0].name, used[f.field][1].source), f) for f in filters]
    if wrong := multiplying(model, joins):
        raise Refused(f"{wrong[0].right} has a key of {', '.join(b for _, b in wrong[0].on)} more than once, so joining it would multiply rows")
    df = model.entity(base).table.alias(base)
    for j in joins:
        on = [qualified(j.left, a) == qualified(j.right, b) for a, b in j.on]
        df = df.join(model.entity(j.right).table.alias(j.right), on, "left")
    for condition in kept:
        df = df.where(condition)
    return df, used, hidden


def metric_groups(model: Model, query: MetricQuery, fold: Callable[[DataFrame, Column], tuple[DataFrame, Column]] | None = None) -> tuple[DataFrame, set[str]]:
    """All groups of a query, without its order and limit, and the names of its keys.

    fold, if given, changes the joined rows and the key of each dimension before they are grouped.
    """
    if not query.measures:
        raise Refused("no measure")
    measures = [model.measure(m) for m in query.measures]
    base = measures[0].entity
    if any(m.entity != base for m in measures):
        raise Refused("measures of two entities")
    if query.grain not in GRAINS:
        raise Refused(f"no grain {query.grain}")
    fields = [*query.dimensions, *([query.time] if query.time else [])]
    df, used, hidden = rows_of(model, base, fields, query.filters, query.permissions)

    keys, taken = [], set()
    if query.time:
        entity, attribute = used[query.time]
        name = f"{query.grain}_of_{attribute.name}"
        keys.append(F.date_trunc(query.grain, qualified(entity.name, attribute.source)).alias(name))
        taken.add(name)
    for d in query.dimensions:
        entity, attribute = used[d]
        name = output_name(model, entity, attribute)
        own = qualified(entity.name, attribute.source)
        own = mask_kind(own, attribute.pii) if hidden(attribute) else own
        if fold:
            df, own = fold(df, own)
        keys.append(own.alias(name))
        taken.add(name)
    of = lambda c: qualified(base, c)
    plain = [m for m in measures if m.agg != "median" or m.column is None]
    values = [aggregate(m, of).alias(m.name) for m in plain]
    if len(plain) == len(measures):
        return (df.groupBy(*keys).agg(*values) if keys else df.agg(*values)), taken
    values = values or [F.count(F.lit(1)).alias("__n")]
    out = df.groupBy(*keys).agg(*values) if keys else df.agg(*values)
    return with_medians(out, df, keys, [m for m in measures if m not in plain], of).select(*out.columns[: len(keys)], *[m.name for m in measures]), taken


def with_medians(out: DataFrame, rows: DataFrame, keys: list[Column], medians: list[Measure], of: Callable[[str], Column]) -> DataFrame:
    """The groups with medians beside, which are found by distributed selection: jobs that run while the plan is made."""
    names = out.columns[: len(keys)]
    kept = lambda m: of(m.column) if m.constraint is None else F.when(predicate(of(m.constraint.field), m.constraint), of(m.column))
    found = quantiles(rows, dict(zip([f"__k{i}" for i in range(len(keys))], keys, strict=True)), {m.name: kept(m) for m in medians}, (0.5,))
    wide = found.groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(*[F.max(F.when(F.col("of") == m.name, F.col("q0"))).alias(f"__m{i}") for i, m in enumerate(medians)])
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"__k{i}")) for i, n in enumerate(names)], F.lit(True))
    return out.join(wide, same, "left").withColumns({m.name: F.col(f"__m{i}") for i, m in enumerate(medians)})


def metric_query(model: Model, query: MetricQuery, fold: Callable[[DataFrame, Column], tuple[DataFrame, Column]] | None = None) -> DataFrame:
    """Time, dimensions and measures, in that order, as the query asks; Refused if it has no correct answer."""
    out, taken = metric_groups(model, query, fold)
    names = out.columns
    order = query.order or ((query.measures[0], True),)
    if wrong := [c for c, _ in order if c not in names]:
        raise Refused(f"ordered by {wrong[0]}, which is not selected")
    ties = [c for c in names if c in taken and c not in {c for c, _ in order}]
    by = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order]
    return out.orderBy(*by, *[F.col(c).asc_nulls_last() for c in ties]).limit(max(1, min(query.limit, MOST_ROWS)))


def masked_notes(model: Model, query: MetricQuery) -> list[str]:
    """A note for each dimension that the query shows masked."""
    out = []
    for d in query.dimensions:
        pii = model.attribute(d)[1].pii
        if pii is not None and pii not in query.permissions:
            out.append(f"{d} is masked as {pii} ({STRATEGIES.get(pii, 'redact')})")
    return out


def dimension_values(model: Model, path: str, measure: str, search: str | None = None, limit: int = 100) -> DataFrame:
    """The values of a dimension with a measure (a count), those that contain `search` only, most frequent first."""
    found = (Filter(path, "contains", search),) if search else ()
    return metric_query(model, MetricQuery((measure,), (path,), filters=found, limit=min(limit, MOST_VALUES)))
