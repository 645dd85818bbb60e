"""Updates as rewritten columns: operators run in their order on the rows that match.

$set $unset $inc $mul $min $max $rename $push $addToSet $pull $pop $currentDate on fields and paths through structs;
replacement documents; upserts seeded from equality conditions. The result is a new DataFrame; what to write it to
is the caller's choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..functions.compare import column_class, is_number, literal, negate, same, type_of, value_class, widened
from ..functions.ids import object_id
from ..plans.filters import compile_filter, field, is_operators
from .pipeline import at

OPERATORS = ("$set", "$unset", "$inc", "$mul", "$min", "$max", "$rename", "$push", "$addToSet", "$pull", "$pop", "$currentDate")


def validate(update: dict, id_col: str = "_id") -> bool:
    """Whether update is made of operators (else it replaces the document)."""
    operators = is_operators(update)
    if not operators:
        if any(k.startswith("$") for k in update):
            raise EngineError("operators and fields are mixed")
        return False
    for op, fields in update.items():
        if op not in OPERATORS:
            raise EngineError(f"unknown update operator {op}")
        if not isinstance(fields, dict) or not fields:
            raise EngineError(f"{op} wants fields")
        for name, v in fields.items():
            for path in [name, v] if op == "$rename" else [name]:
                if not isinstance(path, str) or not path or any(not s or s.startswith("$") for s in path.split(".")):
                    raise EngineError(f"bad path {path!r}")
                if path.split(".")[0] == id_col:
                    raise EngineError(f"{id_col} can't change")
            if op in ("$inc", "$mul") and not is_number(v):
                raise EngineError(f"{op} wants a number")
    return True


def _sum_type(t: T.DataType, v) -> T.DataType:
    """The type of arithmetic on t and v: whole numbers are long, so that what leaves int's range is right."""
    kind = widened(t, v)
    return T.LongType() if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)) else T.DoubleType() if isinstance(kind, T.FloatType) else kind


def _fitting(t: T.DataType | None, v, what: str) -> T.DataType:
    """The type of a field of type t that is to hold v."""
    if t is None or isinstance(t, T.NullType):
        return type_of(v)
    if v is not None and value_class(v) != column_class(t):
        raise EngineError(f"{what} of a {value_class(v)} to a field of {column_class(t)}s")
    return widened(t, v)


def _equals(t: T.DataType, v):
    return lambda e: same(e, t, v)


def changed(op: str, c: Column | None, t: T.DataType | None, v) -> Column:
    """The new value of a field c of type t (None: the schema has no such field)."""
    if op == "$set":
        return literal(v, _fitting(t, v, op))
    if op == "$unset":
        return F.lit(None).cast(t or T.NullType())
    if op == "$currentDate":
        return F.date_trunc("millisecond", F.current_timestamp()).cast(t or T.TimestampType())
    if op in ("$inc", "$mul"):
        if c is None:
            return literal(v if op == "$inc" else type(v)(0), type_of(v))
        if not isinstance(t, T.NumericType):
            raise EngineError(f"{op} of a field that isn't a number")
        kind = _sum_type(t, v)
        x = literal(v, kind)
        return F.coalesce(c.cast(kind) + x, x) if op == "$inc" else F.coalesce(c.cast(kind) * x, F.lit(0).cast(kind))
    if op in ("$min", "$max"):
        if c is None:
            return literal(v, type_of(v))
        kind = widened(t, v)
        x, own = literal(v, kind), c.cast(kind)
        nan = F.isnan(own) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.lit(False)
        less = nan | (own <= x)
        # null is the smallest value; a field of the schema is present
        return F.when(own.isNull(), own if op == "$min" else x).when(less if op == "$min" else ~nan & (own >= x), own).otherwise(x)
    each = v["$each"] if isinstance(v, dict) and list(v) == ["$each"] else [v]
    if op in ("$push", "$addToSet"):
        if t is not None and not isinstance(t, T.ArrayType):
            raise EngineError(f"{op} to a field that isn't an array")
        kind = t.elementType if isinstance(t, T.ArrayType) else None
        for x in each:
            kind = _fitting(kind, x, op)
        kind = kind or T.NullType()
        out = F.coalesce(c.cast(T.ArrayType(kind)), F.array().cast(T.ArrayType(kind))) if c is not None else F.array().cast(T.ArrayType(kind))
        for x in each:
            one = F.array(literal(x, kind))
            grown = F.concat(out, one)
            out = grown if op == "$push" else F.when(F.exists(out, _equals(kind, x)), out).otherwise(grown)
        return out
    if c is None:
        return F.lit(None)
    if not isinstance(t, T.ArrayType):
        raise EngineError(f"{op} of a field that isn't an array")
    if op == "$pull":
        return F.filter(c, lambda e: negate(same(e, t.elementType, v)))
    size = F.greatest(F.size(c) - 1, F.lit(0))
    return F.when(c.isNotNull(), F.slice(c, 2, size) if v < 0 else F.slice(c, 1, size))


def _nested(c: Column | None, t: T.StructType, path: list[str], make) -> Column:
    """c with the field at path made anew; documents on the way that are null or not in the schema are created."""
    f = field(t, path[0])
    base = None if c is None or not t.fields else F.when(c.isNull(), F.struct(*[F.lit(None).cast(x.dataType).alias(x.name) for x in t.fields])).otherwise(c)
    own = c[path[0]] if f and c is not None else None
    if len(path) == 1:
        new = make(own, f.dataType if f else None)
    else:
        if f is not None and not isinstance(f.dataType, T.StructType):
            raise EngineError(f"no document at {path[0]}")
        new = _nested(own, f.dataType if f else T.StructType([]), path[1:], make)
    return F.struct(new.alias(path[0])) if base is None else base.withField(path[0], new)


def _without(c: Column, t: T.StructType, path: list[str]) -> Column:
    """c with the field at path null."""
    f = field(t, path[0])
    inner = F.lit(None).cast(f.dataType) if len(path) == 1 else _without(c[path[0]], f.dataType, path[1:])
    return F.when(c.isNotNull(), c.withField(path[0], inner))


def _put(df: DataFrame, path: list[str], make) -> DataFrame:
    """df with the field at path made anew where __match holds."""
    f = field(df.schema, path[0])
    old = F.col(f"`{path[0]}`") if f else None
    if len(path) > 1:
        if f is not None and not isinstance(f.dataType, T.StructType):
            raise EngineError(f"no document at {path[0]}")
        new = _nested(old, f.dataType if f else T.StructType([]), path[1:], make)
    else:
        new = make(old, f.dataType if f else None)
    if old is not None and isinstance(f.dataType, T.StructType):
        kind = df.select(new.alias("x")).schema["x"].dataType
        old = old if kind == f.dataType else _as(old, f.dataType, kind)
    return df.withColumn(path[0], F.when(F.col("__match"), new).otherwise(old if old is not None else F.lit(None)))


def _as(c: Column, t: T.DataType, to: T.DataType) -> Column:
    """c of type t as the wider type `to`: fields that t lacks are null."""
    if not isinstance(t, T.StructType):
        return c.cast(to)
    parts = [(_as(c[f.name], field(t, f.name).dataType, f.dataType) if field(t, f.name) else F.lit(None).cast(f.dataType)).alias(f.name) for f in to.fields]
    return F.when(c.isNotNull(), F.struct(*parts))


def apply(df: DataFrame, matches: Column, update: dict) -> DataFrame:
    """df with update's operators applied to the rows where `matches` is true."""
    df = df.withColumn("__match", F.coalesce(matches, F.lit(False)))
    for op, fields in update.items():
        for name, v in fields.items():
            path = name.split(".")
            c, t = at(df.schema, name)
            if op == "$rename":
                if c is None:
                    continue
                df = _put(df.withColumn("__moved", c), v.split("."), lambda old, kind, t=t: F.col("__moved"))
                f = field(df.schema, path[0])
                gone = _without(F.col(f"`{path[0]}`"), f.dataType, path[1:]) if len(path) > 1 else F.lit(None).cast(f.dataType)
                df = df.withColumn(path[0], F.when(F.col("__match"), gone).otherwise(F.col(f"`{path[0]}`"))).drop("__moved")
            elif c is not None or op not in ("$unset", "$pull", "$pop"):
                df = _put(df, path, lambda c, t, op=op, v=v: changed(op, c, t, v))
    return df.drop("__match")


def outcome(df: DataFrame, matches: Column, update: dict, id_col: str = "_id") -> DataFrame:
    """One row: how many documents of df match and how many of them an update changes."""
    names = df.columns
    held = df.withColumn("__old", F.struct(*[F.col(f"`{c}`") for c in names])).withColumn("__hit", F.coalesce(matches, F.lit(False)))
    new = apply(held, F.col("__hit"), update) if is_operators(update) else replace(held, F.col("__hit"), update | {"__keep": None}, id_col, ("__old", "__hit"))
    differs = F.lit(False)
    for f in new.schema.fields:
        if f.name not in ("__old", "__hit"):
            was = F.col("__old")[f.name] if f.name in names else F.lit(None)
            same_type = f.name in names and df.schema[f.name].dataType == f.dataType
            differs |= ~F.col(f"`{f.name}`").eqNullSafe(was if same_type or f.name not in names else was.cast(f.dataType))
    return new.agg(F.count(F.when(F.col("__hit"), 1)).alias("matched"), F.count(F.when(F.col("__hit") & differs, 1)).alias("modified"))


def replace(df: DataFrame, matches: Column, document: dict, id_col: str = "_id", kept: tuple = ()) -> DataFrame:
    """df with the matching rows' fields replaced; fields that the document lacks become null, the id (and `kept`) stays."""
    document = {k: v for k, v in document.items() if k != "__keep"}
    df = df.withColumn("__match", F.coalesce(matches, F.lit(False)))
    for name in [*df.columns, *[k for k in document if k not in df.columns]]:
        if name not in (id_col, "__match", *kept):
            df = _put(df, [name], lambda c, t, v=document.get(name): changed("$set", c, t, v))
    return df.drop("__match")


def seed(spec: dict) -> dict:
    """The equality conditions of a filter, $eq and $and included: what an upserted document starts from."""
    out = {}
    for name, v in (spec or {}).items():
        if name == "$and":
            for part in v:
                out |= seed(part)
        elif not name.startswith("$"):
            if is_operators(v):
                if "$eq" in v:
                    out[name] = v["$eq"]
            else:
                out[name] = v
    return out


def upsert(df: DataFrame, spec: dict, update: dict, id_col: str = "_id") -> DataFrame:
    """The rows to add to df when nothing matches spec: one, or none. A scalar check, not a collected result.

    The row starts from spec's equality conditions, at any path. A key that they don't give is a new object id where the
    key is a string, else an error."""
    start, operators = seed(spec), validate(update, id_col)
    if not operators:
        start = ({id_col: start[id_col]} if id_col in start else {}) | update
    row = df.filter(compile_filter(spec, df.schema)).limit(1).agg(F.count(F.lit(1)).alias("__n")).filter("__n = 0")
    row = row.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    if start:
        row = apply(row, F.lit(True), {"$set": start})
    key = field(df.schema, id_col)
    if key is not None and start.get(id_col) is None:
        if not isinstance(key.dataType, T.StringType):
            raise EngineError(f"an upsert needs a {id_col}")
        row = row.withColumn(id_col, object_id())
    return apply(row, F.lit(True), update) if operators else row
