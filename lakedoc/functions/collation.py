"""View collation: one total order over JSON values.

null < false < true < number < string < array < object; arrays by elements, then the
shorter first; strings by bytes; all objects are equal. Keys of one type keep their column,
whose order in Spark is already this one. Mixed keys become a struct of a rank and one
slot for each kind, which sorts and groups natively.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fields import kind_of_type, kind_of_value

RANK = {"null": 0, "false": 1, "true": 2, "number": 3, "string": 4, "array": 5, "object": 6}
KEY = "struct<rank:int,number:double,string:string>"


def mixed_key(value: Column, body_type: T.DataType | None = None) -> Column:
    """A scalar VARIANT (or typed scalar) as an orderable struct; arrays and objects take part by rank alone."""
    if body_type is not None and not isinstance(body_type, T.VariantType):
        kind = kind_of_type(body_type)
        rank = F.when(value, 2).otherwise(1) if kind == "boolean" else F.lit(RANK[kind])
        return F.struct(F.when(value.isNull(), 0).otherwise(rank).cast("int").alias("rank"), (value if kind == "number" else F.lit(None)).cast("double").alias("number"), (value if kind == "string" else F.lit(None)).cast("string").alias("string"))
    t = F.schema_of_variant(value)
    number = t.isin("BIGINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL")
    rank = F.when(t.isNull() | (t == "VOID"), 0).when(t == "BOOLEAN", F.when(F.try_variant_get(value, "$", "boolean"), 2).otherwise(1)).when(number, 3).when(t == "STRING", 4).when(t.startswith("ARRAY"), 5).otherwise(6)
    return F.struct(rank.cast("int").alias("rank"), F.when(number, F.try_variant_get(value, "$", "double")).alias("number"), F.when(t == "STRING", F.try_variant_get(value, "$", "string")).alias("string"))


def mixed_array_key(value: Column) -> Column:
    """A VARIANT array of scalars as an array of such structs."""
    return F.transform(F.try_variant_get(value, "$", "array<variant>"), mixed_key)


def compare(columns: list[Column], types: list[T.DataType], bound, inclusive: bool, less: bool) -> Column:
    """Whether a key lies before (``less``) or after ``bound`` in collation order, or on it if ``inclusive``.

    A key of several columns is an array; ``bound`` may be a shorter list, which sorts before its extensions.
    """
    array = len(columns) > 1 or isinstance(bound, (list, tuple))
    if array and not isinstance(bound, (list, tuple)):
        return F.lit(not less) if kind_of_value(bound) != "object" else F.lit(less)  # arrays come after every scalar
    if not array:
        return _scalar(columns[0], types[0], bound, inclusive, less)
    bound = list(bound)
    n = min(len(columns), len(bound))
    rest = len(columns) - len(bound)  # the shorter one comes first if all else is equal
    tied = inclusive if rest == 0 else (rest < 0) == less
    parts = [F.lit(tied)]
    for k in range(n - 1, -1, -1):
        strict = _scalar(columns[k], types[k], bound[k], False, less)
        same = _same(columns[k], types[k], bound[k])
        parts.append(strict | (same & parts[-1]))
    return parts[-1]


def _rank_of(value) -> int:
    kind = kind_of_value(value)
    return RANK[("true" if value else "false") if kind == "boolean" else kind]


def _scalar(c: Column, t: T.DataType, bound, inclusive: bool, less: bool) -> Column:
    kind, other = kind_of_type(t), kind_of_value(bound)
    if other == "null":
        return (c.isNull() if less else F.lit(True)) if inclusive else (F.lit(False) if less else c.isNotNull())
    if kind == other and kind != "object":
        v = F.lit(bound).cast(t) if isinstance(t, (T.DateType, T.TimestampType)) else F.lit(bound)
        if less:
            return c.isNull() | (c <= v if inclusive else c < v)
        return F.coalesce(c >= v if inclusive else c > v, F.lit(False))
    if kind == "object" and other == "object":
        return F.lit(inclusive) | (c.isNull() if less else F.lit(False))
    before = (RANK["true"] if kind == "boolean" else RANK[kind]) < _rank_of(bound)
    return F.lit(True) if before and less else c.isNull() if less else c.isNotNull() & F.lit(not before)


def _same(c: Column, t: T.DataType, bound) -> Column:
    if bound is None:
        return c.isNull()
    return F.coalesce(c == F.lit(bound), F.lit(False)) if kind_of_type(t) == kind_of_value(bound) else F.lit(False)


def key_equals(columns: list[Column], types: list[T.DataType], key) -> Column:
    if len(columns) == 1 and not isinstance(key, (list, tuple)):
        return _same(columns[0], types[0], key)
    if not isinstance(key, (list, tuple)) or len(key) != len(columns):
        return F.lit(False)
    return reduce(and_, [_same(c, t, k) for c, t, k in zip(columns, types, key, strict=True)])


def key_in(columns: list[Column], types: list[T.DataType], keys: list) -> Column:
    return reduce(or_, [key_equals(columns, types, k) for k in keys]) if keys else F.lit(False)


def canonical(value) -> str:
    """A literal as the JSON text by which keys are told apart."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
