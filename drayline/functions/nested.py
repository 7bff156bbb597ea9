"""Nested cells as JSON text (M5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def flatten_nested(value: Column, dtype: T.DataType, keep_arrays: bool) -> tuple[Column, T.DataType]:
    """JSON text for maps, structs, variants and, by default, arrays.

    With ``keep_arrays`` (targets that store arrays) the array itself stays
    and only its map or struct elements become JSON text.
    """
    if not isinstance(dtype, _NESTED):
        return value, dtype
    if keep_arrays and isinstance(dtype, T.ArrayType):
        if not isinstance(dtype.elementType, _NESTED):
            return value, dtype
        _, element = flatten_nested(value, dtype.elementType, True)
        changed = F.transform(value, lambda x: flatten_nested(x, dtype.elementType, True)[0])
        return changed, T.ArrayType(element, dtype.containsNull)
    return F.to_json(value), T.StringType()
