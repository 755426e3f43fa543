"""Logical types of Spark columns."""

from __future__ import annotations

from pyspark.sql import types as T

NUMERIC = ("integer", "float", "decimal")
TEMPORAL = ("date", "timestamp")
TEXT = ("string", "unknown")
KEY_TYPES = ("string", "integer", "date", "timestamp")


def logical_type(kind: T.DataType) -> str:
    """One of string, integer, float, decimal, boolean, date, timestamp, json, binary, unknown."""
    if isinstance(kind, (T.StructType, T.MapType, T.ArrayType, T.VariantType)):
        return "json"
    for types, name in (
        ((T.StringType, T.CharType, T.VarcharType), "string"),
        ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "integer"),
        ((T.FloatType, T.DoubleType), "float"),
        ((T.DecimalType,), "decimal"),
        ((T.BooleanType,), "boolean"),
        ((T.DateType,), "date"),
        ((T.TimestampType, T.TimestampNTZType), "timestamp"),
        ((T.BinaryType,), "binary"),
    ):
        if isinstance(kind, types):
            return name
    return "unknown"


#: What a logical type is stored as.
SPARK_TYPES = {
    "string": "string", "integer": "bigint", "float": "double", "decimal": "decimal(38,9)", "boolean": "boolean",
    "date": "date", "timestamp": "timestamp", "json": "string", "binary": "binary", "unknown": "string",
}
