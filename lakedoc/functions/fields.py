"""Dotted field paths as columns, over typed columns or a VARIANT body.

A field has a *kind*: ``null boolean number string array object``. Typed columns have one
kind, known before the query runs; a VARIANT has one for each row. A missing field is null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("null", "boolean", "number", "string", "array", "object")


def kind_of_type(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, (T.StructType, T.MapType)):
        return "object"
    if isinstance(t, T.NullType):
        return "null"
    return "string"  # dates and timestamps compare as their ISO strings do


def kind_of_value(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    if isinstance(v, str):
        return "string"
    if isinstance(v, (list, tuple)):
        return "array"
    if isinstance(v, dict):
        return "object"
    raise ValueError(f"not a JSON value: {v!r}")


@dataclass
class Typed:
    """A field of one static type."""

    column: Column
    type: T.DataType

    @property
    def kind(self) -> str:
        return kind_of_type(self.type)

    def is_kind(self, kind: str) -> Column:
        if self.kind == "null" or kind == "null":
            return self.column.isNull() if kind == "null" else F.lit(False)
        return self.column.isNotNull() if self.kind == kind else F.lit(False)

    def as_kind(self, kind: str) -> Column:
        """The value where it is of that kind, else null."""
        if self.kind != kind:
            return F.lit(None)
        return self.column

    def element_kind(self) -> str:
        return kind_of_type(self.type.elementType)

    @property
    def integral(self) -> Column:
        return self.column if isinstance(self.type, T.IntegralType) else F.lit(None).cast("long")

    def json(self) -> Column:
        return F.to_json(self.column) if self.kind in ("array", "object") else self.column.cast("string")


@dataclass
class Variant:
    """A field of a VARIANT body: its kind is found row by row."""

    body: Column
    path: str

    @property
    def value(self) -> Column:
        return F.try_variant_get(self.body, self.path, "variant")

    @property
    def column(self) -> Column:
        return self.value

    def is_kind(self, kind: str) -> Column:
        t = F.schema_of_variant(self.value)
        match kind:
            case "null":
                return F.coalesce(t == "VOID", F.lit(True))
            case "number":
                found = t.isin("BIGINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL")
            case "string":
                found = t == "STRING"
            case "boolean":
                found = t == "BOOLEAN"
            case "array":
                found = t.startswith("ARRAY")
            case _:
                found = t.startswith("OBJECT")
        return F.coalesce(found, F.lit(False))

    def as_kind(self, kind: str) -> Column:
        t = {"number": "double", "string": "string", "boolean": "boolean", "array": "array<variant>"}.get(kind)
        got = F.try_variant_get(self.body, self.path, t) if t else F.to_json(self.value)
        return F.when(self.is_kind(kind), got)

    @property
    def integral(self) -> Column:
        return F.when(F.schema_of_variant(self.value) == "BIGINT", F.try_variant_get(self.body, self.path, "bigint"))

    def json(self) -> Column:
        return F.to_json(self.value)


class Fields:
    """Resolves paths against the columns of a DataFrame and, if it has one, a VARIANT column ``body``."""

    def __init__(self, df: DataFrame, body: str | None = None):
        self.df, self.body = df, body
        self.columns = {f.name: f for f in df.schema.fields}

    def __call__(self, path: str) -> Typed | Variant:
        parts = path.split(".")
        head = self.columns.get(parts[0])
        if "" in parts:
            return Typed(F.lit(None), T.NullType())
        if head is not None and parts[0] != self.body:
            if isinstance(head.dataType, T.VariantType):
                return Variant(F.col(f"`{parts[0]}`"), _json_path(parts[1:]))
            column, t = F.col(f"`{parts[0]}`"), head.dataType
            for k, p in enumerate(parts[1:], 1):
                if isinstance(t, T.StructType) and p in t.fieldNames():
                    column, t = column.getField(p), t[p].dataType
                elif isinstance(t, T.MapType):
                    column, t = F.try_element_at(column, F.lit(p)), t.valueType
                elif isinstance(t, T.VariantType):
                    return Variant(column, _json_path(parts[k:]))
                else:
                    return Typed(F.lit(None), T.NullType())
            return Variant(column, "$") if isinstance(t, T.VariantType) else Typed(column, t)
        if self.body is not None:
            return Variant(F.col(f"`{self.body}`"), _json_path(parts))
        return Typed(F.lit(None), T.NullType())


def _json_path(parts: list[str]) -> str:
    if any("'" in p for p in parts):
        raise ValueError("quotes in field names are not supported")
    return "$" + "".join(f"['{p}']" for p in parts)
