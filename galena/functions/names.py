"""What names say about columns and tables, and identifiers that are safe to write."""

from __future__ import annotations

import re

# Vocabularies of name segments (lower case, joined by underscores).
MEASURE_WORDS = (
    "total sum amount amt revenue cost qty quantity count cnt avg average mean rate ratio pct percent margin score balance "
    "value ytd mtd qtd wtd rolling cumulative net gross price salary weight height temperature duration latency rent noi "
    "opex capex sqft sqm area footage occupancy yield escalation"
).split()
IDENTIFIER_ENDS = "id key code no num number uuid guid sk pk".split()
CURRENCY_WORDS = (
    "amount amt revenue sales cost price value spend salary balance fee charge payment total subtotal discount tax profit "
    "gmv arr mrr usd eur gbp inr"
).split()
RATIO_WORDS = "pct percent rate ratio avg average mean margin score index".split()
BRONZE_WORDS = "raw landing stg staging src source ingest bronze tmp temp".split()
SILVER_WORDS = "silver clean cleansed conformed curated std standard core".split()
GOLD_WORDS = "gold dim fact f d agg aggregate mart summary report kpi metric rpt obt".split()
AUDIT_WORDS = "ingested_at loaded_at load_ts extract_ts _ingest batch_id file_name source_file source_system record_hash op_type is_deleted".split()
AUDIT_STARTS = "etl cdc".split()
GRAIN_WORDS = "year quarter month week day date period region country segment category channel department team bucket band tier grain".split()
WATERMARK_NAMES = (
    "systemmodstamp last_modified_date lastmodifieddate last_modified_at last_modified modified_at modified_date modified_on "
    "date_modified updated_at updated_on updated_date date_updated _ingested_at ingested_at loaded_at load_ts etl_timestamp "
    "changed_at change_date row_version rowversion sys_change_version created_at created_on creation_date date_created inserted_at"
).split()
INSERT_ONLY_NAMES = "created_at created_on creation_date date_created inserted_at".split()
MONOTONIC_ENDS = "id seq sequence version revision offset".split()

IDENTIFIER_CHARS = 120


def normalise(name: str) -> str:
    """Lower case, runs of anything but letters and digits as one underscore, none at the ends."""
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def has_words(name: str, words) -> bool:
    """Whether one of the words stands in the normalised name as a whole segment (or several)."""
    padded = f"_{normalise(name)}_"
    return any(f"_{w.strip('_')}_" in padded for w in words)


def ends_with(name: str, words) -> bool:
    return normalise(name).rpartition("_")[2] in words


def is_measure(name: str) -> bool:
    return has_words(name, MEASURE_WORDS)


def is_identifier(name: str) -> bool:
    return ends_with(name, IDENTIFIER_ENDS)


def is_key_like(name: str) -> bool:
    """Ends in _id or _key, or is id: `paid` and `bid` are not."""
    return ends_with(name, ("id", "key"))


def is_ratio(name: str) -> bool:
    return has_words(name, RATIO_WORDS)


def is_audit(name: str) -> bool:
    return has_words(name, AUDIT_WORDS) or normalise(name).split("_")[0] in AUDIT_STARTS


def is_grain(name: str) -> bool:
    return has_words(name, GRAIN_WORDS)


def is_currency(name: str) -> bool:
    return has_words(name, CURRENCY_WORDS)


def layer_of_name(name: str) -> str | None:
    """The layer that a table's name speaks of, raw words first."""
    for layer, words in (("bronze", BRONZE_WORDS), ("gold", GOLD_WORDS), ("silver", SILVER_WORDS)):
        if has_words(name, words):
            return layer
    return None


def safe_identifier(name: str) -> str:
    """A column or table name of letters, digits and single underscores, starting with a letter."""
    segments = re.findall("[0-9a-z]+", name.lower())
    if segments and segments[0][0].isdigit():
        segments.insert(0, "t")
    return "_".join(segments)[:IDENTIFIER_CHARS] or "unnamed"
