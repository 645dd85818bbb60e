"""Aggregation pipelines as DataFrame plans: $match $project $sort $skip $limit $count $unwind $group.

Rows of a DataFrame have no order, so a pipeline carries its order as sort columns: $sort puts its keys in front, $unwind
adds the element's position, $group and $count clear it. $skip, $limit, $first, $last and $push use it; the result is sorted
only where a $sort asked for it.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..functions.compare import literal, type_of
from ..plans.filters import check, compile_filter, field
from .projection import id_of, projected

_HIDDEN = "__order_"


def sort_columns(df: DataFrame, spec: dict, strict: bool = False) -> list[tuple[Column, bool]]:
    """(key, ascending) pairs: null first, NaN before all numbers; arrays aren't entered."""
    out = []
    for name, way in spec.items():
        if isinstance(way, bool) or not isinstance(way, (int, float)) or not way or (strict and way not in (1, -1)):
            raise EngineError(f"bad sort direction {way!r}")
        c, t = at(df.schema, name)
        up = way > 0
        if c is None:
            continue
        if isinstance(t, (T.DoubleType, T.FloatType)):
            out += [(c.isNotNull(), up), (~F.isnan(c), up)]
        out.append((c, up))
    return out


def at(schema: T.StructType, name: str) -> tuple[Column | None, T.DataType | None]:
    """The column of a dotted path through structs only."""
    c, t = None, schema
    if any(not s or s.startswith("$") for s in name.split(".")):
        raise EngineError(f"bad path {name!r}")
    for s in name.split("."):
        f = field(t, s) if isinstance(t, T.StructType) else None
        if f is None:
            return None, None
        c, t = (F.col(f"`{s}`") if c is None else c[s]), f.dataType
    return c, t


def expression(e, schema: T.StructType) -> tuple[Column, T.DataType | None]:
    """A group expression: constants, '$path', {name: expr}, [expr], {$literal: x}."""
    if isinstance(e, str) and e.startswith("$"):
        if e.startswith("$$"):
            raise EngineError("no variables")
        c, t = at(schema, e[1:])
        return (F.lit(None), None) if c is None else (c, t)
    if isinstance(e, dict):
        if list(e) == ["$literal"]:
            return constant(e["$literal"]), type_of(e["$literal"])
        if any(k.startswith("$") for k in e):
            raise EngineError(f"no operator {next(k for k in e if k.startswith('$'))}")
        return F.struct(*[expression(v, schema)[0].alias(k) for k, v in e.items()]), T.StructType()
    if isinstance(e, (list, tuple)):
        return F.array(*[expression(v, schema)[0] for v in e]), T.ArrayType(T.NullType())
    return constant(e), type_of(e)


def constant(v) -> Column:
    import datetime as dt

    return literal(v, T.TimestampType()) if isinstance(v, dt.datetime) else F.lit(v)


def _ordered(order) -> list[Column]:
    return [c.asc_nulls_first() if up else c.desc_nulls_last() for c, up in order]


def _number(c: Column, t: T.DataType | None) -> tuple[Column, T.DataType]:
    if isinstance(t, T.FloatType):
        return c.cast("double"), T.DoubleType()
    return c, t


def accumulate(op: str, arg, df: DataFrame, order) -> Column:
    if op == "$count":
        if arg != {}:
            raise EngineError("$count wants {}")
        return F.count(F.lit(1))
    if isinstance(arg, dict) and any(k.startswith("$") and k != "$literal" for k in arg):
        raise EngineError("no operators in accumulators")
    c, t = expression(arg, df.schema)
    if op in ("$sum", "$avg"):
        if not isinstance(t, T.NumericType):
            return F.lit(0) if op == "$sum" else F.lit(None).cast("double")
        c, t = _number(c, t)
        if op == "$sum":
            return F.coalesce(F.sum(c), F.lit(0))
        if isinstance(t, T.DecimalType):
            return F.sum(c) / F.count(c)
        return F.sum(c).cast("double") / F.when(F.count(c) > 0, F.count(c))
    if op in ("$min", "$max"):
        c, t = _number(c, t)
        if isinstance(t, T.DoubleType):
            if op == "$max":
                return F.coalesce(F.max(F.when(~F.isnan(c), c)), F.max(c))
            return F.when(F.max(F.isnan(c)), F.lit(float("nan"))).otherwise(F.min(c))
        return F.min(c) if op == "$min" else F.max(c)
    if op in ("$first", "$last"):
        if not order:
            return F.first(F.struct(c.alias("v")))["v"] if op == "$first" else F.last(F.struct(c.alias("v")))["v"]
        keys, up = _struct(order)
        lead = F.min_by if (op == "$first") == up else F.max_by
        return lead(F.struct(c.alias("v")), keys)["v"]
    if op == "$push":
        if not order:
            return F.transform(F.collect_list(F.struct(c.alias("v"))), lambda x: x["v"])
        keys, up = _struct(order)
        rows = F.sort_array(F.collect_list(F.struct(keys.alias("k"), c.alias("v"))), up)
        return F.transform(rows, lambda x: x["v"])
    raise EngineError(f"unknown accumulator {op}")


def _struct(order) -> tuple[Column, bool]:
    """One comparable key of an order in one direction."""
    if len({up for _, up in order}) > 1:
        raise EngineError("an order of mixed directions has no plain key")
    return F.struct(*[c.alias(f"k{k}") for k, (c, _) in enumerate(order)]), order[0][1]


def descending(c: Column, t: T.DataType) -> Column | None:
    """A value whose ascending order is the descending order of c; None for types that have none."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.bitwise_not(c)
    if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
        return -c
    if isinstance(t, T.BooleanType):
        return ~c
    if isinstance(t, T.DateType):
        return -F.unix_date(c)
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return -F.unix_micros(c.cast("timestamp"))
    if isinstance(t, (T.StringType, T.BinaryType)):
        return F.concat(F.translate(F.hex(c.cast("binary")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))
    return None


def one_way(df: DataFrame, order):
    """The order with ascending keys only, or None where a key's type has no reverse."""
    types = df.select(*[c.alias(f"k{i}") for i, (c, _) in enumerate(order)]).schema.fields
    out = []
    for (c, up), f in zip(order, types, strict=True):
        if not up:
            out.append((c.isNull(), True))
            c = descending(c, f.dataType)
        if c is None:
            return None
        out.append((c, True))
    return out


def check_group(spec: dict) -> None:
    empty = T.StructType([])
    expression(spec["_id"], empty)
    for name, acc in spec.items():
        if name == "_id":
            continue
        if not isinstance(acc, dict) or len(acc) != 1 or not name or "." in name or name.startswith("$"):
            raise EngineError(f"bad accumulator {name!r}")
        (op, arg), = acc.items()
        if op not in ("$sum", "$avg", "$min", "$max", "$count", "$push", "$first", "$last"):
            raise EngineError(f"unknown accumulator {op}")
        if op == "$count" and arg != {}:
            raise EngineError("$count wants {}")
        if op != "$count":
            expression(arg, empty)


class Pipeline:
    """A validated list of stages; run() applies them to a DataFrame. `ties`: columns that fix the base order."""

    def __init__(self, stages: list[dict]):
        for s in stages:
            if not isinstance(s, dict) or len(s) != 1:
                raise EngineError("a stage has one operator")
            (op, arg), = s.items()
            if op in ("$skip", "$limit") and (isinstance(arg, bool) or not isinstance(arg, int) or not 0 <= arg < 2**31):
                raise EngineError(f"{op} wants a number from 0")
            if op == "$count" and (not isinstance(arg, str) or not arg or "$" in arg or "." in arg or "\0" in arg):
                raise EngineError("$count wants a field name")
            if op == "$unwind" and (not isinstance(arg, str) or not arg.startswith("$") or arg.startswith("$$") or len(arg) < 2):
                raise EngineError("$unwind wants '$path'")
            if op == "$group":
                if not isinstance(arg, dict) or "_id" not in arg:
                    raise EngineError("$group wants _id")
                check_group(arg)
            if op in ("$match", "$project") and not isinstance(arg, dict):
                raise EngineError(f"{op} wants a document")
            if op == "$match":
                check(arg)
            if op == "$project":
                projected(T.StructType([]), arg)
            if op == "$unwind" and isinstance(arg, str):
                at(T.StructType([]), arg[1:])
            if op == "$sort":
                if not isinstance(arg, dict) or not arg or any(isinstance(v, bool) or v not in (1, -1) for v in arg.values()):
                    raise EngineError("$sort wants 1 or -1")
                for name in arg:
                    at(T.StructType([]), name)
            if op not in ("$match", "$project", "$sort", "$skip", "$limit", "$count", "$unwind", "$group"):
                raise EngineError(f"unknown stage {op}")
        self.stages = stages

    def run(self, df: DataFrame, ties: tuple = ()) -> DataFrame:
        order: list[tuple[Column, bool]] = [(F.col(c), True) for c in ties]
        hidden: list[str] = []
        serial, asked = itertools.count(), False
        for s in self.stages:
            (op, arg), = s.items()
            if op == "$match":
                df = df.filter(compile_filter(arg, df.schema))
            elif op == "$sort":
                order, asked = sort_columns(df, arg, True) + order, True
            elif op == "$project":
                names = [f"{_HIDDEN}{next(serial)}" for _ in order]
                visible = T.StructType([f for f in df.schema.fields if f.name not in hidden])
                df = df.select(*projected(visible, *id_of(visible, arg, ties)), *[c.alias(n) for n, (c, _) in zip(names, order, strict=True)])
                order = [(F.col(n), up) for n, (_, up) in zip(names, order, strict=True)]
                hidden = names
            elif op in ("$skip", "$limit"):
                if order:
                    df = df.orderBy(*_ordered(order))
                df = df.offset(arg) if op == "$skip" else df.limit(arg)
            elif op == "$count":
                df, order, hidden = df.groupBy(F.lit(1).alias("_one")).agg(F.count(F.lit(1)).alias(arg)).select(arg), [], []
                ties, asked = (), False
            elif op == "$unwind":
                df, order, hidden = self._unwind(df, arg[1:], order, hidden)
            else:
                df, order, hidden = self._group(df, arg, order), [], []
                ties, asked = (), False
        if asked:
            df = df.orderBy(*_ordered(order))
        return df.drop(*hidden) if hidden else df

    @staticmethod
    def _unwind(df, path, order, hidden):
        c, t = at(df.schema, path)
        if c is None:
            return df.filter(F.lit(False)), order, hidden
        if not isinstance(t, T.ArrayType):
            return df.filter(c.isNotNull()), order, hidden
        head, _, rest = path.partition(".")
        place = f"{_HIDDEN}p{len(hidden)}"
        wide = df.select("*", F.posexplode(c).alias(place, "__value"))
        value = F.col("__value") if not rest else F.col(head).withField(rest, F.col("__value"))
        cols = [value.alias(n) if n == head else F.col(f"`{n}`") for n in df.columns]
        return wide.select(*cols, place), [*order, (F.col(place), True)], [*hidden, place]

    @staticmethod
    def _group(df, spec, order):
        key, _ = expression(spec["_id"], df.schema)
        mixed = len({up for _, up in order}) > 1 and any(k in v for v in spec.values() if isinstance(v, dict) for k in ("$first", "$last", "$push"))
        if mixed and (plain := one_way(df, order)):
            order = plain
        elif mixed:
            df = df.withColumn(f"{_HIDDEN}n", F.row_number().over(Window.partitionBy(key).orderBy(*_ordered(order))))
            order = [(F.col(f"{_HIDDEN}n"), True)]
        parts = []
        for name, acc in spec.items():
            if name == "_id":
                continue
            if not isinstance(acc, dict) or len(acc) != 1 or not name or "." in name or name.startswith("$"):
                raise EngineError(f"bad accumulator {name!r}")
            (op, arg), = acc.items()
            parts.append(accumulate(op, arg, df, order).alias(name))
        grouped = df.groupBy(key.alias("_id"))
        return grouped.agg(*parts) if parts else grouped.agg(F.count(F.lit(1)).alias("__n")).drop("__n")
