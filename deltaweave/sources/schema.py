"""Schemas inferred from one sample row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql.types import BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType


def infer_type(value: object) -> DataType:
    """Booleans, whole numbers, other numbers; everything else is text."""
    if isinstance(value, bool):
        return BooleanType()
    if isinstance(value, int) or (isinstance(value, float) and value.is_integer()):
        return LongType()
    if isinstance(value, float):
        return DoubleType()
    return StringType()


def infer_schema(sample: Mapping[str, object]) -> StructType:
    return StructType([StructField(name, infer_type(value)) for name, value in sample.items()])
