"""Filter documents as Catalyst predicates.

A filter is a dict: field conditions, and $and / $or / $nor lists. A path goes through structs by name; through arrays of
structs to any element, or by position with a numeric segment. A column that the schema has is present (null
included); any other path is missing, which equals null. Conditions on one field each look at the whole field, so
different elements of an array may satisfy them; $elemMatch wants one element for all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..functions.compare import column_class, negate, ordered, same

Leaf = Callable[[Column | None, T.DataType], Column]

#: Names and numbers of value types; fixed values.
TYPE_NAMES = {
    "double": "double", "string": "string", "object": "document", "document": "document", "array": "array", "bindata": "binary", "binary": "binary", "objectid": "objectid", "bool": "bool",
    "boolean": "bool", "date": "datetime", "datetime": "datetime", "null": "null", "int": "int", "int32": "int", "long": "long", "int64": "long", "decimal": "decimal", "decimal128": "decimal",
    1: "double", 2: "string", 3: "document", 4: "array", 5: "binary", 7: "objectid", 8: "bool", 9: "datetime", 10: "null", 16: "int", 18: "long", 19: "decimal",
}


def field(t: T.StructType, name: str) -> T.StructField | None:
    return next((f for f in t.fields if f.name == name), None)


def position(segment: str) -> int | None:
    return int(segment) if segment.isascii() and segment.isdigit() else None


def at_path(c: Column | None, t: T.DataType, path: list[str], leaf: Leaf, missing: Column) -> Column:
    """leaf of what the path reaches in c; `missing` where it reaches nothing."""
    if not path:
        return leaf(c, t)
    head, rest = path[0], path[1:]
    if isinstance(t, T.StructType):
        f = field(t, head)
        if f is None:
            return missing
        inner = at_path(F.col(f"`{head}`") if c is None else c[head], f.dataType, rest, leaf, missing)
        return inner if c is None else F.when(c.isNull(), missing).otherwise(inner)
    if isinstance(t, T.ArrayType):
        i = position(head)
        if i is not None:
            return F.when(c.isNull(), missing).when(F.size(c) > i, at_path(F.get(c, i), t.elementType, rest, leaf, missing)).otherwise(F.lit(False))
        if isinstance(t.elementType, T.StructType):
            return F.when(c.isNull(), missing).otherwise(F.exists(c, lambda x: x.isNotNull() & at_path(x, t.elementType, path, leaf, missing)))
        return F.when(c.isNull(), missing).otherwise(F.lit(False))
    return missing


def any_of(test: Leaf) -> Leaf:
    """test on the value itself or on any element of an array."""

    def leaf(c, t):
        own = test(c, t)
        if isinstance(t, T.ArrayType):
            return own | (F.exists(c, lambda x: test(x, t.elementType)))
        return own

    return leaf


def truth(v) -> bool:
    return v if isinstance(v, bool) else False if v is None else v != 0 if isinstance(v, (int, float)) else True


def _typed(name: str) -> Leaf:
    def leaf(c, t):
        if name == "null":
            return c.isNull()
        own = {"int": (T.ByteType, T.ShortType, T.IntegerType), "long": T.LongType, "double": (T.DoubleType, T.FloatType), "decimal": T.DecimalType}.get(name)
        fits = isinstance(t, own) if own else column_class(t) == name
        return c.isNotNull() if fits else F.lit(False)

    return leaf


def pattern(regex: str, options: str = "") -> str:
    """A Java pattern: only \\n ends lines; i also folds letters beyond ASCII."""
    if bad := set(options) - set("imsx"):
        raise EngineError(f"bad regex option {sorted(bad)[0]}")
    flags = "d" + "".join("iu" if o == "i" else o for o in dict.fromkeys(options))
    return f"(?{flags}){regex}"


def condition(path: list[str], op: str, v, options: str, reach) -> Column:
    """One operator on the value that reach(leaf, missing) finds."""
    if op == "$eq":
        return reach(any_of(lambda c, t: same(c, t, v)), F.lit(True) if v is None else F.lit(False))
    if op == "$ne":
        return negate(condition(path, "$eq", v, "", reach))
    if op in ("$gt", "$gte", "$lt", "$lte"):
        sign = {"$gt": ">", "$gte": ">=", "$lt": "<", "$lte": "<="}[op]
        return reach(any_of(lambda c, t: ordered(c, t, sign, v)), F.lit(True) if v is None and "=" in sign else F.lit(False))
    if op in ("$in", "$nin"):
        if not isinstance(v, (list, tuple)):
            raise EngineError(f"{op} wants a list")

        def among(c, t):
            out = F.lit(False)
            if plain := [x for x in v if isinstance(x, str)]:
                out = (c.isin(plain)) if isinstance(t, T.StringType) else F.lit(False)
            whole = [x for x in v if isinstance(x, int) and not isinstance(x, bool)]
            if isinstance(t, (T.IntegerType, T.LongType)) and whole:
                limit = 2 ** (31 if isinstance(t, T.IntegerType) else 63)
                out = out | (c.isin([x for x in whole if -limit <= x < limit]))
            else:
                plain = plain + []
                for x in whole:
                    out = out | same(c, t, x)
            for x in v:
                if not isinstance(x, str) and x not in whole or isinstance(x, bool):
                    out = out | same(c, t, x)
            return out

        found = reach(any_of(among), F.lit(True) if any(x is None for x in v) else F.lit(False))
        return found if op == "$in" else negate(found)
    if op == "$all":
        if not isinstance(v, (list, tuple)):
            raise EngineError("$all wants a list")
        if not v:
            return F.lit(False)

        def every(c, t):
            out = F.lit(True)
            for x in v:
                out = out & any_of(lambda c, t, x=x: same(c, t, x))(c, t)
            return out

        return reach(every, F.lit(True) if all(x is None for x in v) else F.lit(False))
    if op == "$exists":
        there = reach(lambda c, t: F.lit(True), F.lit(False))
        return there if truth(v) else negate(there)
    if op == "$size":
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            raise EngineError("$size wants a number")
        return reach(lambda c, t: (F.size(c) == int(v)) if isinstance(t, T.ArrayType) else F.lit(False), F.lit(False))
    if op == "$type":
        name = TYPE_NAMES.get(v.lower() if isinstance(v, str) else v) if isinstance(v, (str, int, float)) and not isinstance(v, bool) else None
        if name is None:
            raise EngineError(f"no type {v!r}")
        return reach(any_of(_typed(name)), F.lit(False))
    if op == "$regex":
        if not isinstance(v, str):
            raise EngineError("$regex wants a string")
        p = pattern(v, options)
        return reach(any_of(lambda c, t: (c.rlike(p)) if isinstance(t, T.StringType) else F.lit(False)), F.lit(False))
    if op == "$not":
        if not is_operators(v):
            raise EngineError("$not wants operators")
        return negate(conditions(path, v, reach))
    if op == "$elemMatch":
        if not isinstance(v, dict):
            raise EngineError("$elemMatch wants a document")
        check_element(v)
        return reach(lambda c, t: (F.exists(c, lambda x: element(x, t.elementType, v))) if isinstance(t, T.ArrayType) else F.lit(False), F.lit(False))
    raise EngineError(f"unknown operator {op}")


def element(x: Column, t: T.DataType, v: dict) -> Column:
    """Whether an array element satisfies an $elemMatch document: operators on itself, or a filter on its fields."""
    if is_operators(v) and not next(iter(v)) in ("$and", "$or", "$nor"):
        return conditions([], v, lambda leaf, missing: leaf(x, t))
    return x.isNotNull() & compile_filter(v, t, x) if isinstance(t, T.StructType) else F.lit(False)


def check(spec: dict | None) -> None:
    """An error where a filter isn't valid, whatever the schema."""
    compile_filter(spec, T.StructType([]))


def check_element(v: dict) -> None:
    if is_operators(v) and next(iter(v)) not in ("$and", "$or", "$nor"):
        conditions([], v, lambda leaf, missing: missing)
    else:
        check(v)


def is_operators(v) -> bool:
    return isinstance(v, dict) and bool(v) and next(iter(v)).startswith("$")


def conditions(path: list[str], operators: dict, reach) -> Column:
    out = F.lit(True)
    for op, v in operators.items():
        if not op.startswith("$"):
            raise EngineError(f"{op} among operators")
        if op != "$options":
            out = out & condition(path, op, v, operators.get("$options", ""), reach)
    return out


def compile_filter(spec: dict | None, schema: T.StructType, root: Column | None = None) -> Column:
    """The predicate of a filter over rows of schema (or over the struct column `root`)."""
    out = F.lit(True)
    for name, v in (spec or {}).items():
        if name in ("$and", "$or", "$nor"):
            if not isinstance(v, (list, tuple)) or not v or not all(isinstance(x, dict) for x in v):
                raise EngineError(f"{name} wants a list of filters")
            parts = [compile_filter(x, schema, root) for x in v]
            joined = parts[0]
            for p in parts[1:]:
                joined = joined & p if name == "$and" else joined | p
            out = out & (negate(joined) if name == "$nor" else joined)
        elif name.startswith("$") or not name:
            raise EngineError(f"unknown operator {name!r}")
        else:
            path = name.split(".")
            reach = lambda leaf, missing, path=path: at_path(root, schema, path, leaf, missing)
            out = out & (conditions(path, v, reach) if is_operators(v) else condition(path, "$eq", v, "", reach))
    return out
