"""A first semantic model from what is known of tables: their profiles, keys and relationships."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.functions.names import is_currency, is_identifier, is_measure, is_ratio, normalise, safe_identifier
from galena.functions.types import NUMERIC, TEMPORAL
from galena.operators.refine import REFINED_AT
from galena.operators.summarise import prefixed
from galena.plans.metrics import Attribute, Entity, Join, Measure, Model


@dataclass(frozen=True)
class Table:
    """A refined table and the facts of it: rows of profile(), and its key, if it has one."""

    name: str
    rows: DataFrame
    facts: list
    key: tuple[str, ...] = ()


@dataclass(frozen=True)
class Derived:
    """The model; the role of each column by entity and column: key, reference, time, number or dimension; each entity's
    distinct values by field, for an overview."""

    model: Model
    roles: dict[tuple[str, str], str]
    cardinality: dict[str, int] = field(default_factory=dict)


#: A dimension with more values than this share of the rows tells rows apart instead of grouping them, and is hidden; tables
#: of few rows count as larger ones.
NEAR_UNIQUE, FEW_ROWS = 0.9, 50
COLUMNS = "entity string, column string, position int, kind string, is_key boolean, refers boolean, pii string, distinct_count bigint"
#: What measurements become: by shape, the aggregation and how the measure's name starts.
MEASURES = (("rate", "avg", "avg"), ("amount", "sum", "total"), ("amount", "avg", "avg"))


def described(columns: DataFrame) -> DataFrame:
    """COLUMNS with the role of each column and its measures (name, agg, format), all tables at once.

    What names say is looked up once for each name. A measurement is a number that neither names a row nor is a whole
    number of an unspeaking name, as that may be a code; a rate is averaged only.
    """
    names = [r[0] for r in columns.select("column").distinct().collect()]  # names of columns, not data
    told = lambda test: F.col("column").isin([c for c in names if test(c)])
    percent = told(lambda c: bool({"pct", "percent"} & set(normalise(c).split("_"))))
    by_kind = F.create_map(*[F.lit(x) for kinds, role in ((TEMPORAL, "time"), (NUMERIC, "number")) for k in kinds for x in (k, role)])
    role = F.coalesce(F.when(F.col("is_key"), "key"), F.when(F.col("refers"), "reference"), F.try_element_at(by_kind, F.col("kind")), F.lit("dimension"))
    measured = (F.col("role") == "number") & ~told(is_identifier) & ((F.col("kind") != "integer") | told(is_measure))
    shape = F.when(measured, F.when(told(is_ratio), "rate").otherwise("amount"))
    shown = F.coalesce(F.when(percent, "percent"), F.when(told(is_currency), "currency"), F.lit("number"))
    named = lambda start: F.coalesce(*[F.when(F.col("column") == c, prefixed(start, c)) for c in names], F.col("column"))
    made = [F.when(F.col("shape") == own, F.struct(named(start).alias("name"), F.lit(agg).alias("agg"), shown.alias("format"))) for own, agg, start in MEASURES]
    return columns.withColumn("role", role).withColumn("shape", shape).withColumn("measures", F.array_compact(F.array(*made))).drop("shape")


def derive_model(tables: list[Table], relationships: list) -> Derived:
    """Entities, attributes, measures and joins of tables.

    relationships: rows of infer_relationships(). Personal data is marked by its kind, so it is masked; references, being
    the other table's key, are hidden, and so are measurements as dimensions, and dimensions of nearly as many values as rows
    (NEAR_UNIQUE). Measures whose names several entities would
    share carry the entity's name.
    """
    names = {t.name: safe_identifier(t.name) for t in tables}
    paths = [r for r in relationships if r["from_dataset"] in names and r["to_dataset"] in names and r["from_dataset"] != r["to_dataset"]]
    refer = {(r["from_dataset"], r["from_column"]) for r in paths}
    rows = [
        (names[t.name], f.column, f.position, f.shadow_type or f.logical_type, f.column in t.key, (t.name, f.column) in refer, f.pii_kind, f.distinct_count)
        for t in tables for f in t.facts if f.column != REFINED_AT
    ]
    spark = tables[0].rows.sparkSession
    columns = described(spark.createDataFrame(rows, COLUMNS)).orderBy("entity", "position").collect()  # a row a column
    of = {t.name: [c for c in columns if c.entity == names[t.name]] for t in tables}
    found = [(c.entity, m.name, m.agg, c.column, m.format) for own in of.values() for c in own for m in c.measures]
    shared = {name for name, n in Counter(name for _, name, *_ in found).items() if n > 1}
    measures = [Measure(f"{e}_count", e, "count") for e in names.values()]
    measures += [Measure(f"{e}_{name}" if name in shared else name, e, agg, column, format=form) for e, name, agg, column, form in found]
    measures.sort(key=lambda m: list(names.values()).index(m.entity))
    rows_of = {t.name: max((f.rows or 0 for f in t.facts), default=0) for t in tables}
    unseen = lambda c, t: c.role == "reference" or bool(c.measures) or (c.role == "dimension" and (c.distinct_count or 0) > NEAR_UNIQUE * max(rows_of[t], FEW_ROWS))
    entities = [Entity(names[t.name], t.rows, tuple(Attribute(c.column, pii=c.pii, hidden=unseen(c, t.name)) for c in of[t.name])) for t in tables]
    roles = {(c.entity, c.column): c.role for c in columns}
    cardinality = {f"{c.entity}.{c.column}": c.distinct_count or 0 for c in columns if c.role == "dimension"}
    unique = {t.name: {f.column for f in t.facts if f.is_unique and f.distinct_is_exact} for t in tables}  # what a profile has counted
    joins = tuple(Join(names[r["from_dataset"]], names[r["to_dataset"]], ((r["from_column"], r["to_column"]),), r["cardinality"] or "many_to_one", r["to_column"] in unique[r["to_dataset"]] or None) for r in paths)
    return Derived(Model(tuple(entities), tuple(measures), joins), roles, cardinality)
