"""Which layer a dataset is at, from the evidence of its profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.functions.names import is_audit, is_grain, is_measure, layer_of_name
from galena.functions.types import KEY_TYPES, NUMERIC, TEMPORAL

# The weight of each piece of evidence.
WEIGHTS = {
    "types_missing_many": 2.5, "types_missing": 1.8, "types_applied": 1.5, "sparse": 1.6, "full": 1.0, "duplicates_many": 2.2,
    "duplicates": 1.4, "no_duplicates": 0.9, "key_declared": 1.8, "key_exact": 1.4, "key_sampled": 1.0, "no_key": 1.8,
    "blanks": 1.2, "metadata": 1.5, "aggregated": 2.6, "wide": 1.6, "normalised": 1.1, "naming": 1.5,
}


def _any_name(test, names: list[str]) -> Column:
    """Whether a column's name passes a test, as an expression over the column names that there are."""
    return F.col("column").isin([c for c in names if test(c)])


def classify_layers(profiles: DataFrame, tables: DataFrame) -> DataFrame:
    """dataset, layer, confidence, signals: all datasets in one job.

    profiles: rows of profile() with a column dataset. tables: dataset, duplicate_ratio, has_key, key_declared. Tables
    without a profile are bronze with little confidence. Names alone never decide: their weight is below any verdict's.
    """
    names = [r[0] for r in profiles.select("column").distinct().collect()]  # names of columns, not data
    mistyped, null = F.col("shadow_type").isNotNull(), F.col("null_pct")
    numeric = F.col("logical_type").isin(*NUMERIC)
    measure = numeric & _any_name(is_measure, names)
    grain = _any_name(is_grain, names) | F.col("logical_type").isin(*TEMPORAL)
    key_like = F.col("logical_type").isin(*KEY_TYPES) & ~_any_name(is_measure, names) & ~F.coalesce(F.col("shadow_type").isin(*NUMERIC), F.lit(False))
    facts = profiles.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("columns"),
        F.max("rows").alias("rows"),
        F.count_if(mistyped).alias("mistyped"),
        F.avg(null).alias("mean_null"),
        F.count_if(null > 0.6).alias("sparse"),
        F.count_if(F.coalesce(F.col("blanks"), F.lit(0)) > 0).alias("blank"),
        F.count_if(_any_name(is_audit, names)).alias("audit"),
        F.count_if(measure).alias("measures"),
        F.count_if(grain).alias("grains"),
        F.count_if(F.col("is_unique") & key_like).alias("identifiers"),
        F.count_if((F.col("distinct_count") > 1) & (F.col("distinct_count") <= 12)).alias("small"),
    )
    known = [r[0] for r in tables.select("dataset").distinct().collect()]
    named = F.coalesce(*[F.when(F.col("dataset") == d, F.lit(layer_of_name(d))) for d in known if layer_of_name(d)], F.lit(None).cast("string"))
    own = tables.join(facts, "dataset", "left")
    share = F.col("mistyped") / F.col("columns")
    ratio = F.col("duplicate_ratio")

    def signal(what: str, layer, when: Column) -> Column:
        layer = layer if isinstance(layer, Column) else F.lit(layer)
        return F.when(when, F.struct(F.lit(what).alias("id"), layer.alias("layer"), F.lit(WEIGHTS[what]).alias("weight")))

    sparse = (F.col("mean_null") >= 0.25) | (F.col("sparse") >= F.greatest(F.lit(2), F.floor(F.col("columns") / 4)))
    aggregated = (F.col("measures") >= 2) & (F.col("grains") > 0) & (F.col("identifiers") == 0)
    declared = F.coalesce("key_declared", F.lit(False))
    signals = F.array_compact(F.array(
        signal("types_missing_many", "bronze", share >= 0.4),
        signal("types_missing", "bronze", (share >= 0.2) & (share < 0.4)),
        signal("types_applied", "silver", share == 0),
        signal("sparse", "bronze", sparse),
        signal("full", "silver", ~sparse & (F.col("mean_null") <= 0.05)),
        signal("duplicates_many", "bronze", ratio >= 0.05),
        signal("duplicates", "bronze", (ratio >= 0.01) & (ratio < 0.05)),
        signal("no_duplicates", "silver", (ratio < 0.01) & (F.col("rows") > 50)),
        signal("key_declared", "silver", declared),
        signal("key_exact", "silver", ~declared & F.col("has_key")),
        signal("no_key", "bronze", ~declared & ~F.col("has_key")),
        signal("blanks", "bronze", F.col("blank") > 0),
        signal("metadata", "bronze", F.col("audit") > 0),
        signal("aggregated", "gold", aggregated),
        signal("wide", "gold", ~aggregated & (F.col("measures") >= 2) & (F.col("columns") >= 12)),
        signal("normalised", "silver", (F.col("small") >= 2) & (F.col("rows") > 100) & (F.col("measures") == 0)),
        signal("naming", named, named.isNotNull()),
    ))
    own = own.withColumn("signals", signals)
    score = lambda layer: F.aggregate(F.filter("signals", lambda s: s["layer"] == layer), F.lit(0.0), lambda a, s: a + s["weight"])
    own = own.withColumns({layer: score(layer) for layer in ("bronze", "silver", "gold")})
    # Two steps: is it past raw, and if so, is it ready for business? Clean data is no evidence against a summary.
    raw, is_clean, business, cap = F.col("bronze"), F.col("silver"), F.col("gold"), F.lit(WEIGHTS["naming"])
    layer = F.when(raw > is_clean, "bronze").when(business > cap, "gold").otherwise("silver")
    lead = F.when(layer == "bronze", raw).when(layer == "gold", business).otherwise(is_clean)
    after = F.when(layer == "bronze", is_clean).when(layer == "gold", cap).otherwise(F.greatest(raw, business))
    margin = F.least(F.lit(0.98), 0.45 + 0.55 * F.try_divide(lead - after, lead))
    confidence = F.when(lead <= 0, 0.2).otherwise(F.round(margin, 2))
    unknown = F.col("columns").isNull()
    return own.select("dataset", F.when(unknown, "bronze").otherwise(layer).alias("layer"), F.when(unknown, 0.2).otherwise(confidence).alias("confidence"), "signals")
