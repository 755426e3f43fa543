"""Bronze to silver: blanks, types, money, names, copies."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.functions.names import is_audit, is_currency, safe_identifier
from galena.functions.types import NUMERIC, TEXT

REFINED_AT = "_med_refined_at"
TYPES = {"integer": "bigint", "float": "double", "decimal": "decimal(38,9)", "boolean": "boolean", "date": "date", "timestamp": "timestamp"}


def blank_to_null(value: Column) -> Column:
    """Trimmed of spaces; null if nothing is left."""
    return F.nullif(F.trim(value), F.lit(""))


def typed(value: Column, to: str) -> Column:
    """Text as a type: blanks are null, numbers lose all but digits, signs, point and exponent, failures are null."""
    text = blank_to_null(value.cast("string"))
    if to in NUMERIC:
        text = F.nullif(F.regexp_replace(text, "[^0-9eE.+-]", ""), F.lit(""))
        if to == "integer":
            return F.round(text.try_cast("decimal(38,9)"), 0).try_cast("bigint")
    elif to in ("date", "timestamp"):
        text = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), text)
    return text.try_cast(TYPES[to])


def money_places(name: str, logical: str, places: int | None) -> int | None:
    """The scale that a float column of money takes as decimal; None for any other column."""
    return max(places, 2) if logical == "float" and is_currency(name) and places is not None and 0 < places <= 4 else None


@dataclass
class RefinePlan:
    """What refine() does, decided from a profile before the job."""

    actions: list[str] = field(default_factory=list)
    select: list[Column] = field(default_factory=list)
    distinct: bool = False


def plan_refine(facts: list, duplicates: float = 0.0, drop_audit: bool = True) -> RefinePlan:
    """facts: rows of profile(), in the order of the table's columns."""
    plan, taken = RefinePlan(distinct=duplicates > 0), set()
    if plan.distinct:
        plan.actions.append("exact copies of rows are dropped")
    for f in sorted(facts, key=lambda f: f.position):
        if drop_audit and is_audit(f.column):
            plan.actions.append(f"{f.column} is load metadata and is dropped")
            continue
        x, name = F.col(f"`{f.column}`"), safe_identifier(f.column)
        while name in taken:
            name += "_"
        taken.add(name)
        if f.shadow_type:
            x = typed(x, f.shadow_type)
            plan.actions.append(f"{f.column} becomes {f.shadow_type}")
        elif f.logical_type in TEXT:
            x = blank_to_null(x)
        elif places := money_places(f.column, f.logical_type, f.decimal_places):
            x = x.cast(f"decimal(38,{places})")
            plan.actions.append(f"{f.column} is money and becomes decimal of {places} places")
        if name != f.column:
            plan.actions.append(f"{f.column} is called {name}")
        plan.select.append(x.alias(name))
    return plan


def refine(df: DataFrame, plan: RefinePlan, at: Column) -> DataFrame:
    """Copies go by the columns as they came; then one projection; the time of refinement is the last column."""
    own = df.distinct() if plan.distinct else df
    return own.select(*plan.select, at.alias(REFINED_AT))


def drop_ingest_metadata(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if is_audit(c)])


def rename_safe(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: safe_identifier(c) for c in df.columns})


def dedupe_exact(df: DataFrame) -> DataFrame:
    return df.distinct()
