"""Data quality: rules label rows, rejected rows are quarantined, and nothing is lost in between."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.functions.types import NUMERIC
from galena.operators.refine import typed

BREACH_SHARE, BREACH_ROWS = 0.05, 100
REJECTS, WARNS = "_med_rejects", "_med_warnings"


@dataclass(frozen=True)
class Rule:
    """kind: not_null, type, allowed_values, non_negative, range, unique. severity: reject or warn."""

    kind: str
    columns: tuple[str, ...]
    severity: str = "reject"
    to: str | None = None
    values: tuple = ()
    low: object = None
    high: object = None
    reason: str = ""

    @property
    def label(self) -> str:
        return f"{self.kind}:{','.join(self.columns)}"


def fails(rule: Rule) -> Column:
    """Whether a row breaks the rule; null where the rule has nothing to say. Values are literals, never SQL."""
    x = F.col(f"`{rule.columns[0]}`")
    if rule.kind == "not_null":
        return x.isNull()
    if rule.kind == "type":
        # No stricter than the cast that follows: symbols and separators are stripped first.
        return x.isNotNull() & (F.trim(x.cast("string")) != "") & typed(x, rule.to).isNull()
    if rule.kind == "allowed_values":
        return ~x.isin(list(rule.values))
    if rule.kind == "non_negative":
        return x < 0
    if rule.kind == "range":
        low = F.lit(False) if rule.low is None else x < F.lit(rule.low)
        high = F.lit(False) if rule.high is None else x > F.lit(rule.high)
        return low | high
    raise ValueError(f"no kind of rule {rule.kind}")


def _repeats(df: DataFrame, rule: Rule, flag: str) -> DataFrame:
    """df with a flag for the rows whose key another row has; a null key is a key like any other.

    Keys are counted before anything is shuffled, and only those found twice are joined back, so a key that very many
    rows have is one row there, and a table without repeats is not shuffled by its keys for the join.
    """
    own = [f"{flag}_{i}" for i in range(len(rule.columns))]
    keys = [F.col(f"`{c}`").alias(k) for c, k in zip(rule.columns, own, strict=True)]
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(flag)).where(F.col(flag) > 1)
    same = [F.col(f"`{c}`").eqNullSafe(F.col(k)) for c, k in zip(rule.columns, own, strict=True)]
    return df.join(twice, same, "left").drop(*own)


def evaluate(df: DataFrame, rules) -> DataFrame:
    """df with the labels of all failed rules of each severity, joined by "; "; an empty text is a pass."""
    flags, own = {}, df
    for i, r in enumerate(rules):
        if r.kind == "unique":
            flags[r] = f"_med_repeats_{i}"
            own = _repeats(own, r, flags[r])
    broken = lambda r: F.col(flags[r]).isNotNull() if r in flags else fails(r)
    labels = lambda severity: F.concat_ws("; ", *[F.when(broken(r), r.label) for r in rules if r.severity == severity])
    return own.withColumns({REJECTS: labels("reject"), WARNS: labels("warn")}).drop(*flags.values())


def clean(evaluated: DataFrame) -> DataFrame:
    return evaluated.where(F.col(REJECTS) == "").drop(REJECTS, WARNS)


def quarantine(evaluated: DataFrame, run_id: str, at: Column) -> DataFrame:
    """The rejected rows as they came, with the rules they broke, the run, and when."""
    return evaluated.where(F.col(REJECTS) != "").withColumns({"_dq_rule": F.col(REJECTS), "_dq_run_id": F.lit(run_id), "_dq_quarantined_at": at}).drop(REJECTS, WARNS)


def warning_summary(evaluated: DataFrame) -> DataFrame:
    """How many rows carry each set of warnings, the most frequent first."""
    return evaluated.where(F.col(WARNS) != "").groupBy(F.col(WARNS).alias("rule")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule")


def quarantine_summary(quarantined: DataFrame, run_id: str, k: int = 4) -> DataFrame:
    """The k most frequent sets of broken rules of one run."""
    own = quarantined.where(F.col("_dq_run_id") == run_id)
    return own.groupBy(F.col("_dq_rule").alias("rule")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule").limit(k)


def breach(evaluated: DataFrame, share: float = BREACH_SHARE, least: int = BREACH_ROWS) -> DataFrame:
    """total, rejected, and whether so large a share of this run's rows was rejected that the load has to stop."""
    out = evaluated.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(REJECTS) != "").alias("rejected"))
    return out.withColumn("breached", (F.col("total") >= least) & (F.col("rejected") > share * F.col("total")))


def default_policy(facts: list, keys: list[list[str]]) -> list[Rule]:
    """Rules that a profile suggests, each with its reason. facts: rows of profile()."""
    key = set(keys[0]) if keys else set()
    out = []
    for f in facts:
        name = (f.column,)
        if f.column in key:
            out.append(Rule("not_null", name, reason=f"{f.column} is part of the key {', '.join(sorted(key))}"))
        elif f.nulls == 0 and (f.rows or 0) > 50:
            out.append(Rule("not_null", name, "warn", reason=f"none of {f.rows} rows lacks it so far"))
        if f.shadow_type:
            out.append(Rule("type", name, to=f.shadow_type, reason=f"its texts read as {f.shadow_type}, and silver has that type"))
        if f.top_values and f.distinct_count <= 12 and len(f.top_values) == f.distinct_count and f.shadow_type not in NUMERIC:
            out.append(Rule("allowed_values", name, "warn", values=tuple(t.value for t in f.top_values), reason=f"it has only had {f.distinct_count} values so far"))
    return out
