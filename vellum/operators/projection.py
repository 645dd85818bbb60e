"""Projections as rebuilt columns: inclusion, exclusion, $slice, $elemMatch, positions in arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..plans.filters import element, position, truth


def _tree(names) -> dict:
    """Paths as nested dicts; {} is a whole value."""
    root: dict = {}
    for name in names:
        node, path = root, name.split(".")
        if any(not s or s.startswith("$") for s in path):
            raise EngineError(f"bad path {name!r}")
        for k, s in enumerate(path):
            last = k == len(path) - 1
            if s in node and (last or node[s] == {}):
                raise EngineError(f"paths collide at {name!r}")
            node = node.setdefault(s, {})
    _check(root)
    return root


def _check(node: dict) -> None:
    places = [s for s in node if position(s) is not None]
    if len({int(s) for s in places}) < len(places):
        raise EngineError("one position twice")
    for sub in node.values():
        _check(sub)


def _include(c: Column, t: T.DataType, node: dict) -> Column | None:
    if not node:
        return c
    if isinstance(t, T.StructType):
        parts = [(f.name, _include(c[f.name], f.dataType, node[f.name])) for f in t.fields if f.name in node]
        parts = [p.alias(n) for n, p in parts if p is not None]
        return F.when(c.isNotNull(), F.struct(*parts)) if parts else None
    if isinstance(t, T.ArrayType):
        places = sorted(int(s) for s in node if position(s) is not None)
        if places and len(places) == len(node):
            picked = F.filter(F.array(*[F.when(F.size(c) > i, F.struct(F.get(c, i).alias("v"))) for i in places]), lambda x: x.isNotNull())
            return F.when(c.isNotNull(), F.transform(picked, lambda x: x["v"]))
        if isinstance(t.elementType, (T.StructType, T.ArrayType)) and _include(F.col("x"), t.elementType, node) is not None:
            return F.transform(c, lambda x: _include(x, t.elementType, node))
    return None


def _exclude(c: Column, t: T.DataType, node: dict) -> Column | None:
    if not node:
        return None
    if isinstance(t, T.StructType):
        parts = [(f.name, _exclude(c[f.name], f.dataType, node[f.name]) if f.name in node else c[f.name]) for f in t.fields]
        parts = [p.alias(n) for n, p in parts if p is not None]
        return F.when(c.isNotNull(), F.struct(*parts)) if parts else None
    if isinstance(t, T.ArrayType):
        places = sorted(int(s) for s in node if position(s) is not None)
        if places and len(places) == len(node):
            return F.transform(F.filter(F.transform(c, lambda x, i: F.struct(x.alias("v"), i.alias("i"))), lambda x: ~x["i"].isin(places)), lambda x: x["v"])
        return F.transform(c, lambda x: _exclude(x, t.elementType, node)) if isinstance(t.elementType, (T.StructType, T.ArrayType)) else c
    return c


def _fits(t: T.DataType, spec: dict):
    return lambda x: element(x, t, spec)


def slice_of(c: Column, t: T.DataType, arg) -> Column:
    """n first, -n last, or [skip, limit] elements; other values stay as they are."""
    if not isinstance(t, T.ArrayType):
        return c
    if isinstance(arg, (list, tuple)):
        if len(arg) != 2 or arg[1] <= 0:
            raise EngineError("$slice wants [skip, limit] with a positive limit")
        skip, limit = arg
        start = F.lit(skip) if skip >= 0 else F.greatest(F.size(c) + skip, F.lit(0))
        return F.slice(c, start + 1, limit)
    if isinstance(arg, bool) or not isinstance(arg, int):
        raise EngineError("$slice wants a number or a pair")
    return F.slice(c, 1, arg) if arg >= 0 else F.slice(c, F.greatest(F.size(c) + arg, F.lit(0)) + 1, -arg)


def id_of(schema: T.StructType, spec: dict | None, ties: tuple) -> tuple:
    """(spec, id column) of a collection whose key is the first of ties; '_id' in spec means the key, wherever it has another
    name and isn't named itself."""
    key = ties[0] if ties else "_id"
    if spec and key != "_id" and "_id" in spec and "_id" not in schema.names:
        spec = {(key if n == "_id" else n): v for n, v in spec.items() if n != "_id" or key not in spec}
        spec = spec or {key: 1}
    return spec, key


def project(df: DataFrame, spec: dict | None, id_col: str = "_id") -> DataFrame:
    """df with the projected columns."""
    return df.select(*projected(df.schema, spec, id_col))


def projected(schema: T.StructType, spec: dict | None, id_col: str = "_id") -> list[Column]:
    """The columns of a projection: the id first, then fields in their order."""
    if not spec:
        return [F.col(f"`{n}`") for n in schema.names]
    plain, slices, matches = {}, {}, {}
    for name, v in spec.items():
        if isinstance(v, dict):
            if list(v) == ["$slice"]:
                slices[name] = v["$slice"]
            elif list(v) == ["$elemMatch"] and isinstance(v["$elemMatch"], dict) and "." not in name:
                matches[name] = v["$elemMatch"]
            else:
                raise EngineError(f"no computed projection of {name!r}")
        elif isinstance(v, (bool, int, float)):
            plain[name] = truth(v)
        else:
            raise EngineError(f"no computed projection of {name!r}")
    others = {n: v for n, v in plain.items() if n != id_col}
    if len(set(others.values())) > 1:
        raise EngineError("inclusion and exclusion are mixed")
    including = any(others.values()) or bool(matches) or (not others and plain.get(id_col) is True)
    if including and any(not v for v in others.values()):
        raise EngineError("inclusion and exclusion are mixed")
    out = []
    if including:
        names = [n for n in plain if plain[n]] + [n for n in matches] + [n for n in slices]
        if plain.get(id_col, True) and id_col in schema.names and id_col not in names and not any(n.startswith(f"{id_col}.") for n in names):
            names.append(id_col)
        tree = _tree(dict.fromkeys(names))
    else:
        tree = _tree([n for n in plain if not plain[n]])
    order = sorted(schema.fields, key=lambda f: f.name != id_col)
    for f in order:
        c = F.col(f"`{f.name}`")
        if f.name in slices:
            got = slice_of(c, f.dataType, slices[f.name])
        elif f.name in matches:
            got = F.slice(F.filter(c, _fits(f.dataType.elementType, matches[f.name])), 1, 1) if isinstance(f.dataType, T.ArrayType) else F.lit(None).cast(f.dataType)
            got = F.when(F.size(got) > 0, got) if isinstance(f.dataType, T.ArrayType) else got
        elif including:
            got = _include(c, f.dataType, tree[f.name]) if f.name in tree else None
        else:
            got = _exclude(c, f.dataType, tree[f.name]) if f.name in tree else c
        if got is not None:
            out.append(got.alias(f.name))
    return out
