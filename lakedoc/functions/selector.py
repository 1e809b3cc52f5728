"""Declarative selectors as filter conditions.

A selector is a dict; fields are implicitly AND-ed and an empty selector matches nothing. A missing
field is null, so ``$ne`` and ``$nin`` match it. Comparison is strict by kind: numbers
with numbers, strings with strings, everything else is neither less nor greater.

Conditions are never null under a negation. Elsewhere they are plain comparisons, which
Catalyst pushes into the scan.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fields import KINDS, Fields, Typed, Variant, kind_of_type, kind_of_value

GROUPS = ("$and", "$or", "$not", "$nor")


def matches(selector: dict, fields: Fields) -> Column:
    """The condition that a row matches ``selector``."""
    if not isinstance(selector, dict):
        raise ValueError("a selector is an object")
    return _all(selector, fields, "", negated=False) if selector else F.lit(False)


def equality_conditions(selector: dict) -> dict:
    """Top-level fields that the selector binds to one value."""
    found = {}
    for k, v in selector.items():
        if not k.startswith("$"):
            if isinstance(v, dict) and set(v) == {"$eq"}:
                found[k] = v["$eq"]
            elif not isinstance(v, dict):
                found[k] = v
    return found


def _all(selector: dict, fields: Fields, prefix: str, negated: bool) -> Column:
    parts = [_member(k, v, fields, prefix, negated) for k, v in selector.items()]
    return reduce(and_, parts) if parts else F.lit(False)


def _members(value, fields: Fields, prefix: str, negated: bool) -> list[Column]:
    """A group takes a list of selectors, or an object, each member of which counts."""
    items = value if isinstance(value, (list, tuple)) else [{k: v} for k, v in value.items()] if isinstance(value, dict) else None
    if items is None or any(not isinstance(x, dict) for x in items):
        raise ValueError("a group takes a list of selectors")
    return [_all(x, fields, prefix, negated) for x in items]


def _member(key: str, value, fields: Fields, prefix: str, negated: bool) -> Column:
    if key in GROUPS:
        match key:
            case "$and":
                parts = _members(value, fields, prefix, negated)
                return reduce(and_, parts) if parts else F.lit(True)
            case "$or":
                parts = _members(value, fields, prefix, negated)
                return reduce(or_, parts) if parts else F.lit(False)
            case "$not":
                parts = _members(value, fields, prefix, True)
                return ~parts[0] if parts else F.lit(False)
            case _:
                parts = _members(value, fields, prefix, True)
                return ~reduce(or_, parts) if parts else F.lit(True)
    if key.startswith("$"):
        raise ValueError(f"unknown group operator {key}")
    path = f"{prefix}{key}"
    if isinstance(value, dict) and value and all(k.startswith("$") for k in value):
        return reduce(and_, [condition(fields(path), op, arg, negated) for op, arg in value.items()])
    if isinstance(value, dict) and value and not any(k.startswith("$") for k in value):
        return _all(value, fields, f"{path}.", negated)  # an object of fields: one level down
    if isinstance(value, dict) and value:
        raise ValueError(f"operators and fields are mixed in {key}")
    return condition(fields(path), "$eq", value, negated)


def condition(field: Typed | Variant, op: str, arg, negated: bool = True) -> Column:
    """One operator on one field."""
    sure = (lambda c: F.coalesce(c, F.lit(False))) if negated else (lambda c: c)
    match op:
        case "$eq":
            return _equal(field, arg, negated)
        case "$ne":
            return ~_equal(field, arg, True)
        case "$lt" | "$gt":
            return sure(_ordered(field, op, arg))
        case "$lte" | "$gte":
            if kind_of_value(arg) in ("number", "string"):
                return sure(_ordered(field, op, arg))
            return _equal(field, arg, negated)
        case "$exists":
            return ~field.is_kind("null") if arg is not False else field.is_kind("null")
        case "$type":
            if arg not in KINDS:
                raise ValueError(f"$type takes one of {', '.join(KINDS)}")
            return field.is_kind(arg)
        case "$in" | "$nin":
            if not isinstance(arg, (list, tuple)):
                raise ValueError(f"{op} takes a list")
            if op == "$in":
                return _any_of(field, arg, negated)
            return ~_any_of(field, arg, True)
        case "$size":
            if isinstance(arg, bool) or not isinstance(arg, (int, float)):
                raise ValueError("$size takes a number")
            return sure(F.when(field.is_kind("array"), F.size(field.as_kind("array")) == arg)) if _may_be(field, "array") else F.lit(False)
        case "$mod":
            if not isinstance(arg, (list, tuple)) or len(arg) != 2 or any(isinstance(x, bool) or not isinstance(x, int) for x in arg) or arg[0] == 0:
                raise ValueError("$mod takes [divisor, remainder], integers, divisor not 0")
            return sure(field.integral % F.lit(arg[0]).cast("long") == arg[1]) if _may_be(field, "number") else F.lit(False)
        case "$regex":
            if not isinstance(arg, str):
                raise ValueError("$regex takes a string")
            return sure(field.as_kind("string").cast("string").rlike(arg)) if _may_be(field, "string") else F.lit(False)
        case "$all":
            if not isinstance(arg, (list, tuple)):
                raise ValueError("$all takes a list")
            return sure(_contains_all(field, arg))
        case "$elemMatch" | "$allMatch":
            if not _may_be(field, "array"):
                return F.lit(False)
            test = lambda x: reduce(and_, [condition(_element(field, x), o, a, True) for o, a in arg.items()])
            array = field.as_kind("array")
            return sure(F.exists(array, test) if op == "$elemMatch" else (F.size(array) > 0) & F.forall(array, test))
        case "$keyMapMatch":
            if not (isinstance(field, Typed) and isinstance(field.type, T.MapType)):
                return F.lit(False)
            return sure(F.exists(F.map_keys(field.column), lambda k: reduce(and_, [condition(Typed(k, T.StringType()), o, a, True) for o, a in arg.items()])))
    raise ValueError(f"unknown operator {op}")


def _may_be(field: Typed | Variant, kind: str) -> bool:
    return isinstance(field, Variant) or field.kind == kind


def _element(field: Typed | Variant, x: Column) -> Typed | Variant:
    return Variant(x, "$") if isinstance(field, Variant) or isinstance(field.type.elementType, T.VariantType) else Typed(x, field.type.elementType)


def _literal(field: Typed | Variant, arg) -> Column:
    if isinstance(field, Typed) and isinstance(field.type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit(arg).cast(field.type)
    return F.lit(arg)


def _equal(field: Typed | Variant, arg, negated: bool) -> Column:
    kind = kind_of_value(arg)
    if kind == "null":
        return field.is_kind("null")
    if not _may_be(field, kind):
        return F.lit(False)
    if kind in ("array", "object"):
        if isinstance(field, Variant):
            return field.is_kind(kind) & F.coalesce(_canonical(field.json()) == F.lit(json.dumps(arg, sort_keys=True, separators=(",", ":"), ensure_ascii=False)), F.lit(False))
        if kind == "array" and field.element_kind() in ("number", "string", "boolean") and all(kind_of_value(x) == field.element_kind() for x in arg):
            found = field.column == F.array(*[_literal(Typed(None, field.type.elementType), x) for x in arg]).cast(field.type if field.element_kind() != "number" else T.ArrayType(T.DoubleType()))
            return F.coalesce(found, F.lit(False)) if negated else found
        if kind == "array" and not arg:
            return F.coalesce(F.size(field.column) == 0, F.lit(False))
        if kind == "object" and isinstance(field.type, T.StructType):
            fields = [Typed(field.column.getField(f.name), f.dataType) for f in field.type]
            if not set(arg) <= set(field.type.fieldNames()):
                return F.lit(False)
            return reduce(and_, [_equal(x, arg.get(f.name), True) for x, f in zip(fields, field.type, strict=True)], field.column.isNotNull())
        return F.lit(False)
    found = field.as_kind(kind) == _literal(field, arg)
    return F.coalesce(found, F.lit(False)) if negated else found


def _canonical(text: Column) -> Column:
    return text  # VARIANT objects keep their keys sorted, and to_json writes no blanks


def _ordered(field: Typed | Variant, op: str, arg) -> Column:
    kind = kind_of_value(arg)
    if kind not in ("number", "string") or not _may_be(field, kind):
        return F.lit(False)
    c, v = field.as_kind(kind), _literal(field, arg)
    return {"$lt": c < v, "$lte": c <= v, "$gt": c > v, "$gte": c >= v}[op]


def _any_of(field: Typed | Variant, values, negated: bool) -> Column:
    plain = [v for v in values if kind_of_value(v) in ("number", "string", "boolean")]
    parts = [_equal(field, v, negated) for v in values if kind_of_value(v) not in ("number", "string", "boolean")]
    for kind in ("number", "string", "boolean"):
        same = [v for v in plain if kind_of_value(v) == kind]
        if same and _may_be(field, kind):
            found = field.as_kind(kind).isin([_literal(field, v) for v in same])
            parts.append(F.coalesce(found, F.lit(False)) if negated else found)
    return reduce(or_, parts) if parts else F.lit(False)


def _is(value):
    return lambda x: _equal(Variant(x, "$"), value, True)


def _contains_all(field: Typed | Variant, values) -> Column:
    if not _may_be(field, "array"):
        return F.lit(False)
    array = field.as_kind("array")
    if isinstance(field, Typed) and not isinstance(field.type.elementType, T.VariantType):
        kind = kind_of_type(field.type.elementType)
        if any(kind_of_value(v) != kind for v in values):
            return F.lit(False)
        return reduce(and_, [F.array_contains(array, _literal(Typed(None, field.type.elementType), v)) for v in values], F.size(array) > 0)
    return reduce(and_, [F.exists(array, _is(v)) for v in values], F.size(array) > 0)
