"""Python-style truthiness as native column expressions.

An option counts as *set* when it is truthy: not null, and not ``''``,
``0``, ``False`` or an empty array/map. ``is_defined`` is the weaker
test (``is not None``) that "requires any" uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_truthy(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(dtype, T.StringType):
        test = c != F.lit("")
    elif isinstance(dtype, T.NumericType):
        test = c != F.lit(0)
    elif isinstance(dtype, (T.ArrayType, T.MapType)):
        test = F.size(c) > 0
    else:
        test = F.lit(True)
    return F.coalesce(c.isNotNull() & test, F.lit(False))


def is_defined(name: str) -> Column:
    return F.col(name).isNotNull()
