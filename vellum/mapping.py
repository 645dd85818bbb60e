"""Dataclasses as schemas and rows."""

from __future__ import annotations

import dataclasses
import datetime as dt
import decimal
import enum
import typing
import uuid

from pyspark.sql import types as T

_PLAIN = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType(), dt.datetime: T.TimestampType(), dt.date: T.DateType(), dt.timedelta: T.LongType(), uuid.UUID: T.StringType(), decimal.Decimal: T.DecimalType(38, 10)}


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


def schema_of(kind) -> T.DataType:
    """The Spark type of a dataclass or annotation."""
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin is typing.Union or type(kind).__name__ == "UnionType":
        return schema_of(next(a for a in args if a is not type(None)))
    if origin in (list, set, tuple, frozenset):
        return T.ArrayType(schema_of(args[0]))
    if origin is dict:
        return T.MapType(T.StringType(), schema_of(args[1]))
    if dataclasses.is_dataclass(kind):
        hints = typing.get_type_hints(kind)
        return T.StructType([T.StructField(f.metadata.get("name", camel(f.name)), schema_of(hints[f.name])) for f in dataclasses.fields(kind) if not f.metadata.get("ignore")])
    if isinstance(kind, type) and issubclass(kind, enum.Enum):
        return T.LongType()
    return _PLAIN[kind]


def from_rows(rows, kind) -> list:
    """Rows (or dicts) as instances of a dataclass: its fields only, null for absent ones."""
    return [_from(r.asDict(True) if hasattr(r, "asDict") else r, kind) for r in rows]


def _from(x, kind):
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if x is None:
        return None
    if origin is typing.Union or type(kind).__name__ == "UnionType":
        return _from(x, next(a for a in args if a is not type(None)))
    if origin in (list, set, tuple, frozenset):
        return origin(_from(v, args[0]) for v in x)
    if origin is dict:
        return {k: _from(v, args[1]) for k, v in x.items()}
    if dataclasses.is_dataclass(kind):
        hints = typing.get_type_hints(kind)
        return kind(**{f.name: _from(x.get(f.metadata.get("name", camel(f.name))), hints[f.name]) for f in dataclasses.fields(kind) if not f.metadata.get("ignore")})
    if isinstance(kind, type) and issubclass(kind, (enum.Enum, uuid.UUID)):
        return kind(x)
    return dt.timedelta(microseconds=x // 10) if kind is dt.timedelta else x


def to_row(x):
    """A dataclass instance as plain values for createDataFrame."""
    if dataclasses.is_dataclass(x):
        return {f.metadata.get("name", camel(f.name)): to_row(getattr(x, f.name)) for f in dataclasses.fields(x) if not f.metadata.get("ignore")}
    if isinstance(x, enum.Enum):
        return x.value
    if isinstance(x, uuid.UUID):
        return str(x)
    if isinstance(x, dt.timedelta):
        return (x.days * 86400 + x.seconds) * 10_000_000 + x.microseconds * 10
    if isinstance(x, dict):
        return {k: to_row(v) for k, v in x.items()}
    return [to_row(v) for v in x] if isinstance(x, (list, tuple, set, frozenset)) else x
