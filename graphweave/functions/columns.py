"""Typed literals, typed nulls, and error rows."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweave.errors import ErrorRow
from graphweave.plans.ast import TypeRef

SCALARS = {"ID": T.StringType(), "String": T.StringType(), "Int": T.IntegerType(), "Float": T.DoubleType(), "Boolean": T.BooleanType()}
ERROR_SCHEMA = T.StructType(
    [
        T.StructField("message", T.StringType()),
        T.StructField("path", T.ArrayType(T.StringType())),
        T.StructField("extensions", T.MapType(T.StringType(), T.StringType())),
    ]
)


def scalar_type(name: str) -> T.DataType:
    """Of a scalar or enumeration of the schema; custom scalars are strings unless a binding has a column."""
    return SCALARS.get(name, T.StringType())


def spark_type(kind: TypeRef) -> T.DataType:
    return T.ArrayType(spark_type(kind.inner)) if kind.inner else scalar_type(kind.name)


def null(kind: T.DataType) -> Column:
    return F.lit(None).cast(kind)


def typed(value: Any, kind: T.DataType) -> Column:
    """A literal of a column's own type, so that comparing with it leaves the column bare for pushdown."""
    return F.lit(value).cast(kind)


def equals(column: Column, kind: T.DataType, value: Any) -> Column:
    """A null matches nothing, a list matches any of its values."""
    if isinstance(value, list):
        return column.isin([typed(v, kind) for v in value]) if value else F.lit(False)
    return column == typed(value, kind)


def error_frame(spark: SparkSession, rows: list[ErrorRow]) -> DataFrame:
    return spark.createDataFrame([(r.message, list(r.path), dict(r.extensions)) for r in rows], ERROR_SCHEMA)
