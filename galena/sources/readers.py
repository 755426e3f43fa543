"""Reading and writing tables: files of several kinds, databases, layers, tiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.functions.types import SPARK_TYPES, logical_type

# Words that read as true and as false.
TRUE_WORDS, FALSE_WORDS = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")
PLAIN_TYPES = ("BIGINT", "DOUBLE", "DECIMAL", "BOOLEAN", "STRING", "DATE", "TIMESTAMP")
TABBED = (".tsv", ".txt")


def _kind(path: str) -> str:
    return "." + path.rstrip("/").rpartition(".")[2].lower()


def read_delimited(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Csv with header; .tsv and .txt are split at tabs. Types are inferred unless a schema is given."""
    own = spark.read.option("header", True).option("sep", "\t" if _kind(path) in TABBED else ",")
    return (own.schema(schema) if schema else own.option("inferSchema", True)).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One document a line (.jsonl, .ndjson), or a file that is an array (.json)."""
    own = spark.read.option("multiLine", _kind(path) == ".json")
    return (own.schema(schema) if schema else own).json(path)


def read_drifting_json(spark: SparkSession, path: str) -> DataFrame:
    """One document a line, of fields that come, go and change their types: a row for each line, with a column for each
    field that any line has (by name), `_line` and `_reason`.

    A field has the type that holds all its values; where there is none, and for objects and lists, it is told as text. A
    line that is no JSON, or no object, has nulls and its `_reason` (not json, not an object); blank lines have `blank`.
    Names that are in use or differ in case only have underscores after them; fields with both kinds of quotes in the name
    are left to `_line`. What is gathered by the driver is a row for each field.
    """
    lines = spark.read.text(path).select(F.col("value").alias("_line"))
    doc = F.try_parse_json("_line")
    broken = F.when(F.trim("_line") == "", "blank").when(doc.isNull(), "not json").when(~F.startswith(F.schema_of_variant(doc), F.lit("OBJECT")), "not an object")
    told = lines.select("_line", doc.alias("_doc"), broken.alias("_reason"))
    fields = told.where("_reason is null").lateralJoin(spark.tvf.variant_explode(F.col("_doc").outer())).groupBy("key").agg(F.schema_of_variant_agg("value").alias("type"))
    columns, taken = [], {"_line", "_reason", "_doc"}
    for name, kind in sorted(map(tuple, fields.where("key is not null").collect())):
        if not {"'", '"'} <= set(name):
            quote = '"' if "'" in name else "'"
            own = name
            while own.lower() in taken:
                own += "_"
            taken.add(own.lower())
            plain = kind.split("(")[0] in PLAIN_TYPES
            columns.append(F.try_variant_get("_doc", f"$[{quote}{name}{quote}]", kind if plain else "string").alias(own))
    return told.select(*columns, "_line", "_reason")


def read_remote(spark: SparkSession, path: str) -> DataFrame:
    """A file or folder of any store that Spark reaches (s3a://, abfss://, file:), by the ending of its path."""
    kind = _kind(path)
    if kind in (".parquet", ".pqt"):
        return spark.read.option("recursiveFileLookup", True).parquet(path)
    return read_json(spark, path) if kind in (".json", ".jsonl", ".ndjson") else read_delimited(spark, path)


def read_table_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None, partitions: int = 16, **options) -> DataFrame:
    """A database table, read by as many cursors as there are partitions of a numeric column's range."""
    own = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column:
        low, high = own.load().agg(F.min(partition_column), F.max(partition_column)).first()
        if low is not None:
            own = own.options(partitionColumn=partition_column, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions))
    return own.load()


def describe(df: DataFrame) -> DataFrame:
    """name, native_type, logical_type, nullable, position of each column, with the exact row count."""
    cells = [F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("native_type"), F.lit(logical_type(f.dataType)).alias("logical_type"), F.lit(f.nullable).alias("nullable"), F.lit(i).alias("position")) for i, f in enumerate(df.schema.fields)]
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.explode(F.array(*cells)).alias("c"), "rows").select("c.*", "rows")


@dataclass(frozen=True)
class Sample:
    rows: DataFrame
    truncated: bool


def sample(df: DataFrame, n: int) -> Sample:
    """The first n rows that Spark comes by (not a random sample), and whether there are more."""
    return Sample(df.limit(n), df.limit(n + 1).count() > n)


def conform_column(value: Column, kind: str, to: str) -> Column:
    """A value of logical type `kind` as logical type `to`; what cannot be read is null."""
    if kind == to:
        return value.cast(SPARK_TYPES[to])
    if kind == "binary":
        value, kind = F.try_validate_utf8(value.cast("string")) if to != "string" else F.make_valid_utf8(value.cast("string")), "string"
    if kind == "json":
        value, kind = F.to_json(value), "string"
    if kind != "string":
        return value.try_cast(SPARK_TYPES[to])
    text = F.trim(value)
    if to in ("integer", "float", "decimal"):
        bare = F.regexp_replace(text, ",", "")
        if to != "integer":
            bare = F.regexp_replace(bare, "[$£€₹¥]", "")
        if to == "decimal":
            bare = F.regexp_replace(bare, "%$", "")
        return F.trim(bare).try_cast(SPARK_TYPES[to])
    if to == "boolean":
        low = F.lower(text)
        return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)
    if to in ("date", "timestamp"):
        return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast(to))
    return value.cast(SPARK_TYPES[to])


def conform(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """The columns of `types` (name → logical type), coerced, in that order; missing ones are null."""
    kinds = {f.name: logical_type(f.dataType) for f in df.schema.fields}
    return df.select(*[conform_column(F.col(f"`{c}`"), kinds[c], to).alias(c) if c in kinds else F.lit(None).cast(SPARK_TYPES[to]).alias(c) for c, to in types.items()])


def write_layer(df: DataFrame, root: str, layer: str, name: str, mode: str = "replace") -> str:
    """Writes a table of a layer and returns its path. An empty frame still makes a table with its columns."""
    if layer not in ("bronze", "silver", "gold", "quarantine"):
        raise ValueError(f"no layer {layer}")
    path = f"{root.rstrip('/')}/{layer}/{name}"
    df.write.mode({"replace": "overwrite", "append": "append"}[mode]).parquet(path)
    return path
