"""Silver to gold, and every measure that a table supports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from galena.functions.names import is_grain, is_identifier, is_key_like, is_measure, is_ratio, normalise
from galena.functions.types import NUMERIC, TEMPORAL, logical_type
from galena.operators.profile import conformed, held_values

DIMENSIONS, DIMENSION_VALUES, MEASURES, MEASURE_VALUES = 4, 50, 8, 200
#: Rows a value, in the mean of all groups, from which on values are counted before they are summed.
WEIGHED = 4


def _averaged(name: str) -> list[Column]:
    return [F.avg(F.col(f"`{name}`").cast("double")).alias(prefixed("avg", name))]


def _totalled(name: str) -> list[Column]:
    return [F.sum(f"`{name}`").alias(prefixed("total", name)), *_averaged(name)]


def prefixed(prefix: str, name: str) -> str:
    """The name with the prefix before it, unless it has it already."""
    return name if normalise(name).startswith(f"{prefix}_") else f"{prefix}_{name}"


def summarise(df: DataFrame, facts: list) -> DataFrame | None:
    """Measures by month and up to 4 dimensions, or None where there is nothing to summarise. facts: rows of profile()."""
    own = sorted(facts, key=lambda f: f.position)
    time = next((f.column for f in own if f.logical_type in TEMPORAL), None)
    dims = [f.column for f in own if f.logical_type not in NUMERIC + TEMPORAL and (is_grain(f.column) or 0 < (f.distinct_count or 0) <= DIMENSION_VALUES)][:DIMENSIONS]
    measures = [f.column for f in own if f.logical_type in NUMERIC and not f.is_unique and not is_key_like(f.column)][:MEASURES]
    if not measures or not (dims or time):
        return None
    keys = [F.date_trunc("month", F.col(f"`{time}`")).alias("period_month")] if time else []
    keys += [F.col(f"`{d}`") for d in dims]
    values = [v for m in measures for v in (_averaged(m) if is_ratio(m) else _totalled(m))]
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("record_count"), *values)
    return out.orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in out.columns[: len(keys)]])


def _may_be_measured(column: str, kind: str, foreign_keys=(), by: str | None = None) -> bool:
    """Whether name and type leave it open that a column is a measure."""
    if kind not in NUMERIC or column in foreign_keys or is_identifier(column) or column == by:
        return False
    return kind != "integer" or is_measure(column)


def asked_of(df: DataFrame, foreign_keys=(), by: str | None = None) -> list[str]:
    """The columns whose facts measure_all looks at: those that may be measures, and `by`."""
    return [f.name for f in df.schema.fields if f.name == by or _may_be_measured(f.name, logical_type(f.dataType), foreign_keys, by)]


def _by_value(f, groups: int, kind) -> bool:
    """Whether a measure's values are counted before they are summed. It pays where rows are far more than values in all groups;
    only products of decimals that keep all their digits are sums."""
    return isinstance(kind, DecimalType) and (kind.scale <= 6 or kind.precision <= 17) and WEIGHED * groups * (f.distinct_count + 1) <= f.rows


def _weighed(name: str, kind) -> list[Column]:
    """What _totalled or _averaged give, from how often each value occurs."""
    value, n = F.col("value"), F.col("n")
    mean = F.sum(value.cast("double") * n) / F.sum(F.when(value.isNotNull(), n))
    total = [] if is_ratio(name) else [F.sum(value * n).cast(kind).alias(prefixed("total", name))]
    return [*total, mean.alias(prefixed("avg", name))]


def measure_all(df: DataFrame, facts: list, foreign_keys=(), by: str | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """Every measure the table supports, over all rows or by a dimension of at most 200 values. facts: rows of profile(),
    those of the columns of asked_of() at least. types: as in profile().

    Decimals of few values are counted by value first, each column by itself, and converted and summed once a value; all other
    measures are taken from the rows in one pass. Both ways give the same exact totals."""
    own = {f.column: f for f in facts}
    if by is not None and (own[by].distinct_count or 0) > MEASURE_VALUES:
        raise ValueError(f"{by} has too many values to group by")
    typed, group = conformed(df, types), [F.col(f"`{by}`").alias("by")] if by is not None else []
    groups = own[by].distinct_count + 1 if by is not None else 1
    measures = [f for f in sorted(facts, key=lambda f: f.position) if not f.is_unique and _may_be_measured(f.column, f.logical_type, foreign_keys, by)]
    values = {f.column: _averaged(f.column) if is_ratio(f.column) else _totalled(f.column) for f in measures}
    apart = [f.column for f in measures if _by_value(f, groups, typed.schema[f.column].dataType)]
    count = F.count(F.lit(1)).alias("record_count")
    order = typed.agg(count, *[v for each in values.values() for v in each]).columns
    out = typed.groupBy(*group).agg(count, *[v for c, each in values.items() if c not in apart for v in each])
    for c in apart:
        total = typed.agg(F.sum(f"`{c}`")).schema[0].dataType
        made = held_values(df, c, types, by).groupBy(*["by"] * len(group)).agg(*_weighed(c, total))
        out = out.join(made, out["by"].eqNullSafe(made["by"]) if group else F.lit(True))
        out = out.drop(made["by"]) if group else out
    return out.select(*[F.col("by").alias(by) for _ in group], *[F.col(f"`{c}`") for c in order])


def carry_gold(df: DataFrame) -> DataFrame:
    """Data that is gold already is taken over as it is: averages of averages would be wrong."""
    return df
