"""Exact comparisons of a typed column with a literal.

Numbers compare by exact value across int, double and decimal: literals are known when the query is built, so bounds are
moved to values of the column's type instead of converting the column. NaN belongs to no numeric range and
equals itself. Values of different classes never match. Null counts as
false: conjunctions and disjunctions keep it, so that plain comparisons reach the scan, and negate() settles it.
"""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def negate(c: Column) -> Column:
    """Not c, where null counts as false."""
    return ~F.coalesce(c, F.lit(False))


def is_number(v) -> bool:
    return isinstance(v, (int, float, Decimal)) and not isinstance(v, bool)


def value_class(v) -> str:
    """The class of a literal in the order of values."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "bool"
    if is_number(v):
        return "number"
    for kind, name in ((str, "string"), (dict, "document"), ((list, tuple), "array"), ((bytes, bytearray), "binary"), ((dt.datetime, dt.date), "datetime")):
        if isinstance(v, kind):
            return name
    raise TypeError(f"no such value type: {type(v).__name__}")


def column_class(t: T.DataType) -> str:
    """The class of a column's non-null values."""
    for kind, name in ((T.BooleanType, "bool"), (T.NumericType, "number"), (T.StringType, "string"), (T.StructType, "document"), (T.ArrayType, "array"), (T.BinaryType, "binary"), ((T.TimestampType, T.TimestampNTZType, T.DateType), "datetime")):
        if isinstance(t, kind):
            return name
    return "null" if isinstance(t, T.NullType) else "other"


def type_of(v) -> T.DataType:
    """The type of a column that holds the literal v."""
    if isinstance(v, bool):
        return T.BooleanType()
    if isinstance(v, int):
        return T.IntegerType() if -(2**31) <= v < 2**31 else T.LongType()
    if isinstance(v, float):
        return T.DoubleType()
    if isinstance(v, Decimal):
        _, digits, exponent = v.as_tuple()
        scale = max(0, -exponent)
        return T.DecimalType(min(38, max(len(digits) + max(0, exponent), scale)), scale)
    if isinstance(v, (list, tuple)):
        return T.ArrayType(type_of(v[0]) if v else T.NullType())
    if isinstance(v, dict):
        return T.StructType([T.StructField(k, type_of(x)) for k, x in v.items()])
    return T.StringType() if isinstance(v, str) else T.BinaryType() if isinstance(v, bytes) else T.NullType() if v is None else T.TimestampType()


def widened(t: T.DataType, v) -> T.DataType:
    """The narrowest type that holds t's values and v, where both are numbers: int, long, double; decimals stay if v fits."""
    if not is_number(v) or not isinstance(t, T.NumericType):
        return t
    order = [T.IntegerType(), T.LongType(), T.DoubleType()]
    if isinstance(t, T.DecimalType):
        x = Fraction(v) * 10**t.scale if not isinstance(v, float) or math.isfinite(v) else Fraction(1, 2)
        return t if x.denominator == 1 and abs(x) < 10**t.precision else T.DoubleType()
    whole = not isinstance(v, int) and math.isfinite(v) and v == int(v)
    own = type_of(int(v)) if whole else type_of(v)
    a = next((i for i, x in enumerate(order) if isinstance(t, type(x))), 2 if isinstance(t, T.FloatType) else 0)
    b = order.index(own) if own in order else 2
    return t if a >= b else order[b]


def _exact(v) -> Fraction:
    return Fraction(v)


def _number(c: Column, t: T.DataType, op: str, v) -> Column:
    floating = isinstance(t, (T.DoubleType, T.FloatType))
    c = c.cast("double") if isinstance(t, T.FloatType) else c
    valid = ~F.isnan(c) if floating else F.lit(True)
    if isinstance(v, (float, Decimal)) and math.isnan(v):
        return F.isnan(c) if floating and op in ("==", ">=", "<=") else F.lit(False)
    if isinstance(v, (float, Decimal)) and math.isinf(v):
        if floating:
            return {"==": c == float(v), ">": c > float(v), ">=": c >= float(v), "<": c < float(v), "<=": c <= float(v)}[op] & valid
        below = (op in ("<", "<=")) == (v > 0) and op != "=="
        return c.isNotNull() if below else F.lit(False)
    x = _exact(v)
    if floating:
        near = float(x) if abs(x) < Fraction(2) ** 1024 else math.copysign(math.inf, x)
        if math.isfinite(near) and Fraction(near) == x:
            return {"==": c == near, ">": c > near, ">=": c >= near, "<": c < near, "<=": c <= near}[op] & valid
        over = math.isinf(near) and near > 0 or math.isfinite(near) and Fraction(near) > x
        if op == "==":
            return F.lit(False)
        return ((c >= near if over else c > near) if op in (">", ">=") else (c < near if over else c <= near)) & valid
    scale = t.scale if isinstance(t, T.DecimalType) else 0
    scaled = x * 10**scale
    if op == "==" and scaled.denominator != 1:
        return F.lit(False)
    bound = math.floor(scaled) if op in (">", "<=") else math.ceil(scaled)
    limit = 10**t.precision if isinstance(t, T.DecimalType) else 2 ** (_BITS[type(t)] - 1)
    if not -limit <= bound < limit:
        if op == "==":
            return F.lit(False)
        return c.isNotNull() if (bound < 0) == (op in (">", ">=")) else F.lit(False)
    if isinstance(t, T.DecimalType):
        value = F.lit(str(Decimal(bound).scaleb(-scale))).cast(t)
    else:
        value = F.lit(bound).cast(t)
    return {"==": c == value, ">": c > value, ">=": c >= value, "<": c < value, "<=": c <= value}[op]


def literal(v, t: T.DataType) -> Column:
    """v as a column of type t; naive and aware datetimes are UTC."""
    if v is None:
        return F.lit(None).cast(t)
    if isinstance(t, T.ArrayType):
        return F.array(*[literal(x, t.elementType) for x in v]).cast(t)
    if isinstance(t, T.StructType):
        return F.struct(*[literal(v[f.name], f.dataType).alias(f.name) for f in t.fields])
    if isinstance(v, dt.datetime):
        utc = v.astimezone(dt.timezone.utc).replace(tzinfo=None) if v.tzinfo else v
        ntz = F.lit(utc.isoformat(" ")).cast("timestamp_ntz")
        return ntz if isinstance(t, T.TimestampNTZType) else F.lit(utc.replace(tzinfo=dt.timezone.utc)).cast(t)
    return F.lit(v).cast(t)


def same(c: Column, t: T.DataType, v) -> Column:
    """Whether the whole value of c equals v (an array or document: exactly and in order)."""
    if v is None:
        return c.isNull()
    if value_class(v) != column_class(t):
        return F.lit(False)
    if is_number(v):
        return _number(c, t, "==", v)
    if isinstance(t, T.ArrayType):
        parts = [same(F.get(c, i), t.elementType, x) for i, x in enumerate(v)]
        out = F.size(c) == len(v)
        for p in parts:
            out = out & p
        return out
    if isinstance(t, T.StructType):
        if list(v) != t.names:
            return F.lit(False)
        out = c.isNotNull()
        for f in t.fields:
            out = out & same(c[f.name], f.dataType, v[f.name])
        return out
    return c == literal(v, t)


def ordered(c: Column, t: T.DataType, op: str, v) -> Column:
    """c op v for one value, within v's class only; null bounds match null where equality is included."""
    if v is None:
        return c.isNull() if op in (">=", "<=") else F.lit(False)
    if value_class(v) != column_class(t):
        return F.lit(False)
    if is_number(v):
        return _number(c, t, op, v)
    x = literal(v, t)
    return {">": c > x, ">=": c >= x, "<": c < x, "<=": c <= x}[op]
