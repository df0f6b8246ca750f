"""Semi-structured columns as VARIANT: which keys they hold, of which types, and typed values of named paths, without a schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """JSON text as a variant; what isn't JSON, and null, is null."""
    return F.try_parse_json(text)


def fields(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """``keys``, key, type and field (variant) of every top-level field of the objects in the variant column ``value``; other values have none.

    Types are those of Spark's schema of a variant: BIGINT, DOUBLE, DECIMAL(..), STRING, BOOLEAN, VOID for JSON's null, OBJECT<..> and ARRAY<..>.
    """
    own = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col(value).outer()).toDF("at__", "key", "field")).where("key is not null")
    return own.select(*keys, "key", F.schema_of_variant("field").alias("type"), "field")


def kind(type_: Column) -> Column:
    """number, string, boolean, null, object or array, of a variant's type."""
    return (
        F.when(F.rlike(type_, F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")), "number").when(type_ == "STRING", "string").when(type_ == "BOOLEAN", "boolean")
        .when(type_ == "VOID", "null").when(F.startswith(type_, F.lit("OBJECT")), "object").when(F.startswith(type_, F.lit("ARRAY")), "array")
    )


def profile(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """``keys``, key, kind, n: how often each key of the objects in ``value`` has a value of each kind."""
    own = fields(rows, value, keys)
    return own.groupBy(*keys, "key", kind(F.col("type")).alias("kind")).agg(F.count("*").alias("n"))


def merged_schema(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """``keys`` and the one schema that all values of a group fit."""
    return rows.groupBy(*keys).agg(F.schema_of_variant_agg(value).alias("schema"))
