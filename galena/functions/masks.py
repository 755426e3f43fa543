"""Masks for personal data. Null stays null; what is too short to mask in part is redacted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What stands for hidden characters, what stands for a hidden value, and the mask of each kind of data.
DOTS = "•••"
REDACTED = "••• masked"
STRATEGIES = {
    "email": "domain", "phone": "last4", "person_name": "initials", "ip_address": "prefix", "postal_code": "prefix",
    "date_of_birth": "year", "national_id": "redact", "credit_card": "redact", "iban": "redact",
    "street_address": "redact", "coordinates": "redact",
}


def mask(value: Column, strategy: str) -> Column:
    """The value as `strategy` shows it; an unknown strategy redacts."""
    text, hidden = value.cast("string"), F.lit(REDACTED)
    at = F.instr(text, "@")
    shown = {
        "domain": F.when(at > 0, F.concat(F.lit(DOTS + "@"), F.substr(text, at + 1))).otherwise(hidden),
        "last4": F.when(F.length(text) >= 4, F.concat(F.lit(DOTS), F.right(text, F.lit(4)))).otherwise(hidden),
        "initials": F.when(F.length(text) >= 1, F.concat(F.substring(text, 1, 1), F.lit(DOTS))).otherwise(hidden),
        "prefix": F.when(F.length(text) >= 3, F.concat(F.substring(text, 1, 3), F.lit(DOTS))).otherwise(hidden),
        "year": F.when(F.length(text) >= 4, F.concat(F.substring(text, 1, 4), F.lit(DOTS))).otherwise(hidden),
    }.get(strategy, hidden)
    return F.when(text.isNull(), F.lit(None)).otherwise(shown)


def mask_kind(value: Column, kind: str | None) -> Column:
    return mask(value, STRATEGIES.get(kind or "", "redact"))


def mask_table(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The table with each column of `kinds` masked as its kind of personal data."""
    return df.withColumns({c: mask_kind(F.col(c), kind) for c, kind in kinds.items()})
