"""Functions over every string of a nested column, whatever its structure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType


def holds_strings(kind: DataType) -> bool:
    """Whether values of the type can hold strings, keys of maps not counted."""
    if isinstance(kind, StructType):
        return any(holds_strings(f.dataType) for f in kind)
    if isinstance(kind, ArrayType):
        return holds_strings(kind.elementType)
    return holds_strings(kind.valueType) if isinstance(kind, MapType) else isinstance(kind, StringType)


def map_strings(column: Column, kind: DataType, f: Callable[[Column], Column]) -> Column:
    """``column`` with ``f`` of each of its strings: in fields of structs, items of arrays and values of maps, at any depth.

    Names, types and the order of fields stay, as do keys of maps; null stays null at every level, and what holds no string isn't touched.
    """
    if not holds_strings(kind):
        return column
    if isinstance(kind, StringType):
        return f(column)
    if isinstance(kind, ArrayType):
        return F.transform(column, lambda x: map_strings(x, kind.elementType, f))
    if isinstance(kind, MapType):
        return F.transform_values(column, lambda _, v: map_strings(v, kind.valueType, f))
    fields = [map_strings(column.getField(x.name), x.dataType, f).alias(x.name) for x in kind]
    return F.when(column.isNotNull(), F.struct(*fields))


def scrubbed(df: DataFrame, column: str, f: Callable[[Column], Column]) -> DataFrame:
    """``df`` with every string of a column rewritten."""
    return df.withColumn(column, map_strings(F.col(column), df.schema[column].dataType, f))
