"""The registered queries of the document language and their SQL."""

from __future__ import annotations

import dataclasses
import datetime as dt
import tempfile
import uuid
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .collection import Collection, PreparedFilter
from .errors import EngineError
from .functions.ids import made_at
from .mapping import from_rows, schema_of, to_row
from .sources.tables import export_json, import_json, parquet, rewrite

_KEYS = {"orders": "o_orderkey", "events": "event_id", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "nation": "n_nationkey", "region": "r_regionkey", "embeddings": "vec_id"}


def _at(spark, sf_dir, table) -> Collection:
    return parquet(spark, f"{sf_dir}/{table}.parquet", _KEYS.get(table))


def _find(table, spec=None, projection=None, **options):
    return lambda spark, sf_dir: _at(spark, sf_dir, table).find(spec, projection, **options)


def _aggregate(table, *stages, flat=None):
    def run(spark, sf_dir):
        out = _at(spark, sf_dir, table).aggregate(list(stages))
        return out.select(*flat(out)) if flat else out

    return run


def _shown(*names):
    return dict.fromkeys(names, 1) | {"_id": 0}


def _nested(spark, sf_dir):
    events = _at(spark, sf_dir, "events")
    df = events.df.withColumn("props", F.from_json("props", T.StructType([T.StructField("k", T.LongType())])))
    return Collection(df, "event_id").find({"props.k": {"$lt": 10}}, _shown("event_id", "props.k")).select("event_id", "props.k")


def _update(table, spec, update, columns, upsert=False):
    return lambda spark, sf_dir: _at(spark, sf_dir, table).update(spec, update, upsert).find().select(*columns)


def _push(spark, sf_dir):
    grown = _at(spark, sf_dir, "embeddings").update({}, {"$push": {"embedding": 0.5}})
    return grown.find({}, _shown("vec_id") | {"embedding": {"$slice": -1}})


def _pull(spark, sf_dir):
    rows = _at(spark, sf_dir, "conversations").aggregate([{"$sort": {"conv_id": 1, "turn": 1}}, {"$group": {"_id": "$conv_id", "roles": {"$push": "$role"}}}])
    c = Collection(rows, "_id").update({}, {"$pull": {"roles": "system"}}).update({}, {"$pop": {"roles": -1}}).update({}, {"$addToSet": {"roles": {"$each": ["user", "tool"]}}})
    return c.find()


def _folder(spark) -> str:
    """A new folder in the shared one; where none is set (tests in one process), in a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def _json_round_trip(spark, sf_dir):
    events, path = _at(spark, sf_dir, "events"), _folder(spark)
    export_json(events.df, path)
    return import_json(spark, path, events.df.schema, "event_id").find({"value": {"$gte": 50}}, {"event_id": 1, "value": 1, "props": 1})


def _rewritten(spark, sf_dir):
    return rewrite(_at(spark, sf_dir, "orders"), _folder(spark)).find({"o_orderpriority": "1-URGENT"}, {"o_totalprice": 1})


def _lines(spark, sf_dir):
    """Orders as documents with an array of their lines."""
    stages = [{"$group": {"_id": "$l_orderkey", "lines": {"$push": {"n": "$l_linenumber", "qty": "$l_quantity", "flag": "$l_returnflag"}}}}]
    return Collection(_at(spark, sf_dir, "lineitem").aggregate(stages), "_id")


def _of_lines(spec):
    return lambda spark, sf_dir: _lines(spark, sf_dir).find(spec, {"_id": 1})


def _roles(spec):
    return lambda spark, sf_dir: _at(spark, sf_dir, "conversations").aggregate([{"$group": {"_id": "$conv_id", "roles": {"$push": "$role"}}}, {"$match": spec}, {"$project": {"_id": 1}}])


def _info(spark, sf_dir) -> Collection:
    """Nations with their name and region in a document."""
    return Collection(_at(spark, sf_dir, "nation").df.select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("info")), "n_nationkey")


def _renamed(spark, sf_dir):
    c = _info(spark, sf_dir).update({"info.region": {"$lte": 2}}, {"$rename": {"info.name": "info.title", "info.region": "region"}})
    return c.df.select("n_nationkey", F.col("info.name").alias("name"), F.col("info.title").alias("title"), F.col("info.region").alias("old_region"), "region")


def _created(spark, sf_dir):
    c = _info(spark, sf_dir).update({"info.region": 3}, {"$set": {"info.place.zone": 7, "extra.tag": "t"}})
    return c.df.select("n_nationkey", F.col("info.place.zone").alias("zone"), F.col("extra.tag").alias("tag"), F.col("info.name").alias("name"))


def _seeded(spark, sf_dir):
    c = _info(spark, sf_dir).update({"n_nationkey": 99, "info.name": "NOWHERE", "fresh": 5, "deep.er": "z"}, {"$inc": {"info.region": 4}}, upsert=True)
    return c.df.select("n_nationkey", F.col("info.name").alias("name"), F.col("info.region").alias("region"), "fresh", F.col("deep.er").alias("deeper"))


def _generated(spark, sf_dir):
    """Documents without a key get object ids; an upsert without one too."""
    docs = Collection(_at(spark, sf_dir, "nation").df.select(F.col("n_name").alias("_id"), "n_regionkey"), "_id")
    more = docs.insert(docs.df.drop("_id")).update({"n_regionkey": -1}, {"$set": {"made": True}}, upsert=True).df
    hexed = F.col("_id").rlike("^[0-9a-f]{24}$")
    return more.agg(F.count(F.lit(1)).alias("n"), F.sum(hexed.cast("long")).alias("generated"), F.countDistinct(F.when(hexed, F.substring("_id", 9, 16))).alias("different"), F.min(F.when(hexed, made_at(F.col("_id")) > F.lit("2024-01-01").cast("timestamp"))).alias("dated"))


def _inserted(spark, sf_dir):
    regions = _at(spark, sf_dir, "region")
    return regions.insert(spark.createDataFrame([(100, "NORTH"), (101, None)], "r_regionkey int, r_name string")).find({"r_regionkey": {"$gte": 3}})


def _clashes(spark, sf_dir):
    """What inserts and changes refuse: 1 for each error."""
    regions, rows = _at(spark, sf_dir, "region"), []
    for name, key in (("there", 1), ("null", None), ("new", 50)):
        try:
            regions.insert(spark.createDataFrame([(key, "X")], "r_regionkey int, r_name string"))
            rows.append((name, 0))
        except EngineError:
            rows.append((name, 1))
    return spark.createDataFrame(rows, "case string, refused int")


def _unique(spark, sf_dir):
    line, orders = _at(spark, sf_dir, "lineitem"), _at(spark, sf_dir, "orders")
    return spark.createDataFrame([("orders", orders.is_unique("o_orderkey")), ("customers of orders", orders.is_unique("o_custkey")), ("lines", line.is_unique("l_orderkey", "l_linenumber"))], "what string, is_unique boolean")


def _visited(spark, sf_dir):
    """The visitor stops at the third urgent order."""
    seen = []

    def visitor(row):
        seen.append((row["o_orderkey"], row["o_custkey"]))
        return len(seen) < 3

    _at(spark, sf_dir, "orders").visit({"o_orderpriority": "1-URGENT"}, visitor)
    return spark.createDataFrame(seen, "o_orderkey long, o_custkey long")


def _read(spark, sf_dir):
    got = _at(spark, sf_dir, "orders").read_by_id(7, lambda row: (row["o_orderkey"], row["o_orderstatus"]))
    return spark.createDataFrame([got] if got else [], "o_orderkey long, o_orderstatus string")


def _prepared(spark, sf_dir):
    wanted = PreparedFilter({"$or": [{"l_quantity": {"$gt": 45}}, {"l_returnflag": "R"}]})
    line = _at(spark, sf_dir, "lineitem")
    return line.counted(wanted).union(Collection(line.df.filter("l_linenumber = 1")).counted(wanted)).select("n")


def _explained(spark, sf_dir):
    plan = _at(spark, sf_dir, "lineitem").explain({"l_quantity": {"$gt": 49}})
    return spark.createDataFrame([("GreaterThan(l_quantity,49" in plan, "FileScan parquet" in plan or "Scan parquet" in plan)], "pushed boolean, scans boolean")


@dataclasses.dataclass
class Supplier:
    key: int = dataclasses.field(metadata={"name": "s_suppkey"})
    name: str = dataclasses.field(metadata={"name": "s_name"})
    balance: float | None = dataclasses.field(metadata={"name": "s_acctbal"})


def _mapped(spark, sf_dir):
    """Rows as dataclass instances and back."""
    first = from_rows(_at(spark, sf_dir, "supplier").find({"s_suppkey": {"$lte": 20}}).collect(), Supplier)
    changed = [dataclasses.replace(x, balance=x.balance * 2) for x in first]
    return spark.createDataFrame([to_row(x) for x in changed], schema_of(Supplier))


def _dated(spark, sf_dir):
    new = _at(spark, sf_dir, "region").update({"r_regionkey": {"$gt": 1}}, {"$currentDate": {"at": True}}).df
    return new.select("r_regionkey", F.col("at").isNotNull().alias("dated"), (F.coalesce(F.col("at") > F.lit("2024-01-01").cast("timestamp"), F.lit(False))).alias("recent"))


def _outcome(table, spec, update, **k):
    return lambda spark, sf_dir: _at(spark, sf_dir, table).update_result(spec, update, **k)


_DAY = dt.datetime

QUERIES = {
    "filter_eq": _find("orders", {"o_orderstatus": "F"}, _shown("o_orderkey", "o_orderstatus")),
    "filter_eq_null": _find("orders", {"nope": None, "o_custkey": {"$eq": 7}}, _shown("o_orderkey")),
    "filter_ne": _find("orders", {"o_orderstatus": {"$ne": "F"}}, _shown("o_orderkey")),
    "filter_range": _find("lineitem", {"l_quantity": {"$gte": 10, "$lt": 20}, "l_discount": {"$gt": 0.05, "$lte": 0.07}}, _shown("l_orderkey", "l_linenumber")),
    "filter_and": _find("lineitem", {"$and": [{"l_quantity": {"$gte": 49.5}}, {"l_linenumber": {"$lte": 2.5}}]}, _shown("l_orderkey", "l_linenumber")),
    "filter_date_range": _find("lineitem", {"l_shipdate": {"$gte": _DAY(1997, 1, 1), "$lt": _DAY(1998, 1, 1)}}, _shown("l_orderkey", "l_linenumber", "l_shipdate")),
    "filter_type_bracket": _aggregate("lineitem", {"$match": {"$or": [{"l_quantity": {"$gt": "a"}}, {"l_returnflag": {"$gt": "N"}}, {"l_returnflag": {"$lt": 5}}]}}, {"$count": "n"}),
    "filter_in": _find("part", {"p_brand": {"$in": ["Brand#1", "Brand#2"]}}, _shown("p_partkey", "p_brand")),
    "filter_nin": _find("part", {"p_size": {"$nin": [1, 2, 3]}}, _shown("p_partkey")),
    "filter_or": _find("events", {"$or": [{"event_type": "error"}, {"value": {"$gt": 90}}]}, _shown("event_id")),
    "filter_nor": _find("events", {"$nor": [{"event_type": "error"}, {"value": {"$gt": 90}}]}, _shown("event_id")),
    "filter_not": _find("events", {"value": {"$not": {"$gt": 50}}}, _shown("event_id")),
    "filter_exists": _find("events", {"$or": [{"nope": {"$exists": True}}, {"event_type": {"$exists": True}, "value": {"$lt": 10}}]}, _shown("event_id")),
    "filter_regex": _find("customer", {"c_name": {"$regex": "0{3}1[0-9]$"}}, _shown("c_custkey", "c_name")),
    "filter_regex_i": _find("part", {"p_name": {"$regex": "^SMALL", "$options": "i"}}, _shown("p_partkey")),
    "filter_type": _aggregate("lineitem", {"$match": {"$or": [{"l_quantity": {"$type": "string"}}, {"l_linenumber": {"$type": "int"}, "l_quantity": {"$gte": 25}}]}}, {"$count": "n"}),
    "filter_positional": _find("embeddings", {"embedding.0": {"$gt": 0}}, _shown("vec_id")),
    "filter_array_any": _find("embeddings", {"embedding": {"$gt": 0.25}}, _shown("vec_id")),
    "filter_elemmatch": _find("embeddings", {"embedding": {"$elemMatch": {"$gt": 0.1, "$lt": 0.11}}}, _shown("vec_id")),
    "filter_size": _roles({"roles": {"$size": 4}}),
    "filter_nested_json": _nested,
    "project_include": _find("nation", {}, _shown("n_name", "n_regionkey")),
    "project_exclude": _find("supplier", {}, {"s_acctbal": 0}),
    "project_slice": _find("embeddings", {}, _shown("vec_id") | {"embedding": {"$slice": [1, 3]}}),
    "project_slice_tail": _find("embeddings", {}, _shown("vec_id") | {"embedding": {"$slice": -2}}),
    "project_elemmatch": _find("embeddings", {}, _shown("vec_id") | {"embedding": {"$elemMatch": {"$gt": 0.2}}}),
    "sort_limit": _find("orders", None, _shown("o_orderkey", "o_totalprice"), sort={"o_totalprice": -1, "o_orderkey": 1}, limit=10),
    "sort_skip_limit": _find("orders", None, _shown("o_orderkey", "o_orderdate"), sort={"o_orderdate": 1, "o_orderkey": 1}, skip=20, limit=15),
    "count_filter": lambda spark, sf_dir: _at(spark, sf_dir, "lineitem").counted({"l_returnflag": "R"}),
    "find_by_id": lambda spark, sf_dir: _at(spark, sf_dir, "orders").find_by_id(42).select("o_orderkey", "o_custkey", "o_totalprice"),
    "agg_match_group_sort": _aggregate(
        "lineitem", {"$match": {"l_shipdate": {"$lte": _DAY(1998, 9, 2)}}},
        {"$group": {"_id": {"f": "$l_returnflag", "s": "$l_linestatus"}, "sum_qty": {"$sum": "$l_quantity"}, "avg_price": {"$avg": "$l_extendedprice"}, "avg_disc": {"$avg": "$l_discount"}, "n": {"$count": {}}}},
        {"$sort": {"_id.f": 1, "_id.s": 1}},
        flat=lambda d: [F.col("_id.f").alias("l_returnflag"), F.col("_id.s").alias("l_linestatus"), F.round("sum_qty", 2).alias("sum_qty"), F.round("avg_price", 2).alias("avg_price"), F.round("avg_disc", 6).alias("avg_disc"), "n"],
    ),
    "agg_group_null_key": _aggregate("events", {"$group": {"_id": None, "n": {"$count": {}}, "lo": {"$min": "$value"}, "hi": {"$max": "$value"}}}, flat=lambda d: [F.col("_id").cast("int").alias("_id"), "n", "lo", "hi"]),
    "agg_sum_int": _aggregate("lineitem", {"$group": {"_id": "$l_returnflag", "s": {"$sum": "$l_linenumber"}}}),
    "agg_first_last": _aggregate("events", {"$sort": {"ts": 1, "event_id": 1}}, {"$group": {"_id": "$user_id", "first": {"$first": "$event_type"}, "last": {"$last": "$event_type"}}}),
    "agg_push": _aggregate("conversations", {"$sort": {"conv_id": 1, "turn": 1}}, {"$group": {"_id": "$conv_id", "roles": {"$push": "$role"}}}),
    "agg_unwind_group": _aggregate("embeddings", {"$unwind": "$embedding"}, {"$group": {"_id": "$label", "n": {"$count": {}}, "mx": {"$max": "$embedding"}}}),
    "agg_count": _aggregate("orders", {"$match": {"o_orderstatus": "O"}}, {"$count": "n"}),
    "agg_skip_limit": _aggregate("customer", {"$sort": {"c_acctbal": -1, "c_custkey": 1}}, {"$skip": 5}, {"$limit": 5}, {"$project": _shown("c_custkey", "c_acctbal")}),
    "agg_limit": _aggregate("region", {"$limit": 3}, {"$project": _shown("r_regionkey", "r_name")}),
    "agg_having": _aggregate("orders", {"$group": {"_id": "$o_custkey", "n": {"$count": {}}}}, {"$match": {"n": {"$gte": 15}}}),
    "agg_two_level": _aggregate("lineitem", {"$group": {"_id": "$l_orderkey", "n": {"$count": {}}}}, {"$group": {"_id": "$n", "orders": {"$count": {}}}}),
    "agg_literal_key": _aggregate("orders", {"$group": {"_id": {"k": "$o_orderstatus", "tag": {"$literal": "$x"}}, "n": {"$count": {}}}}, flat=lambda d: ["_id.k", "_id.tag", "n"]),
    "update_set_inc": _update("supplier", {"s_nationkey": {"$lt": 5}}, {"$inc": {"s_acctbal": 100}, "$set": {"flag": "x"}}, ("s_suppkey", "s_acctbal", "flag")),
    "update_mul_min_max": _update("part", {}, {"$mul": {"p_retailprice": 2}, "$min": {"p_size": 20}, "$max": {"floor": 1}}, ("p_partkey", "p_retailprice", "p_size", "floor")),
    "update_rename_unset": _update("nation", {"n_regionkey": 1}, {"$rename": {"n_name": "title"}, "$unset": {"n_regionkey": 1}}, ("n_nationkey", "n_name", "title", "n_regionkey")),
    "update_push": _push,
    "update_pull_pop_addtoset": _pull,
    "update_one": lambda spark, sf_dir: _at(spark, sf_dir, "orders").update({"o_orderstatus": "O"}, {"$set": {"o_orderstatus": "X"}}, one=True).find({"o_orderstatus": "X"}, _shown("o_orderkey")),
    "delete_many": lambda spark, sf_dir: _at(spark, sf_dir, "events").delete({"event_type": "error"}).find({}, _shown("event_id")),
    "delete_one": lambda spark, sf_dir: _at(spark, sf_dir, "region").delete({"r_regionkey": {"$gte": 2}}, one=True).find({}, _shown("r_regionkey")),
    "find_ids": _find("orders", {"o_orderkey": {"$in": [1, 2, 7, 33, 10**12]}}, {"o_custkey": 1}),
    "find_key_range": _find("orders", {"o_orderkey": {"$gte": 100, "$lt": 200.5}}, {"o_totalprice": 1}),
    "find_one": lambda spark, sf_dir: _at(spark, sf_dir, "orders").find_one({"o_orderstatus": "P"}, {"o_totalprice": 1}, {"o_totalprice": -1}),
    "find_prepared": _prepared,
    "read_by_id": _read,
    "visit": _visited,
    "explain": _explained,
    "filter_all": _roles({"roles": {"$all": ["system", "assistant"]}}),
    "filter_elemmatch_document": _of_lines({"lines": {"$elemMatch": {"n": {"$lte": 2}, "qty": {"$gt": 45}, "flag": {"$ne": "R"}}}}),
    "filter_fan_out": _of_lines({"lines.qty": {"$gte": 49}, "lines.flag": "R"}),
    "project_id": _find("nation", {}, {"n_name": 1}),
    "project_no_id": _find("nation", {}, {"_id": 0, "n_regionkey": 0}),
    "project_positions": _find("embeddings", {}, {"embedding.0": 1, "embedding.2": 1}),
    "project_fan_out": lambda spark, sf_dir: _lines(spark, sf_dir).find({}, {"lines.n": 1}).select("_id", F.size("lines").alias("n"), F.array_max("lines.n").alias("top")),
    "sort_nulls": lambda spark, sf_dir: _at(spark, sf_dir, "supplier").update({"s_nationkey": {"$lt": 3}}, {"$unset": {"s_acctbal": 1}}).find({}, {"s_acctbal": 1}, sort={"s_acctbal": 1}, limit=15),
    "agg_constants": _aggregate("lineitem", {"$group": {"_id": "$l_linestatus", "two": {"$sum": {"$literal": 2}}, "half": {"$sum": Decimal("0.5")}, "three": {"$avg": {"$literal": 3}}, "none": {"$sum": {"$literal": "x"}}}}, flat=lambda d: ["_id", "two", F.col("half").cast("double").alias("half"), "three", "none"]),
    "agg_mixed_order": _aggregate("events", {"$sort": {"event_type": -1, "value": 1, "event_id": -1}}, {"$group": {"_id": "$user_id", "first": {"$first": "$event_id"}, "last": {"$last": "$event_id"}}}),
    "update_set_wider": _update("part", {"p_size": {"$lt": 10}}, {"$set": {"p_size": 2.5}}, ("p_partkey", "p_size")),
    "update_push_wider": lambda spark, sf_dir: _at(spark, sf_dir, "lineitem").aggregate([{"$group": {"_id": "$l_orderkey", "n": {"$push": "$l_linenumber"}}}]).transform(lambda d: Collection(d, "_id").update({"n": 1}, {"$push": {"n": 2.5}}).df).select("_id", F.array_max("n").alias("top"), F.size("n").alias("n"), F.aggregate("n", F.lit(0.0), lambda a, x: a + x).alias("total")),
    "update_inc_overflow": _update("part", {"p_size": {"$gte": 25}}, {"$inc": {"p_size": 2**31 - 1}}, ("p_partkey", "p_size")),
    "update_rename_dotted": _renamed,
    "update_creates_parents": _created,
    "update_current_date": _dated,
    "update_result": _outcome("supplier", {"s_nationkey": {"$lte": 10}}, {"$min": {"s_acctbal": 1000}}),
    "update_result_replace": _outcome("region", {"r_regionkey": {"$gte": 2}}, {"r_name": "ASIA"}),
    "update_result_upsert": _outcome("region", {"r_regionkey": 77}, {"$set": {"r_name": "X"}}, upsert=True),
    "delete_result": lambda spark, sf_dir: _at(spark, sf_dir, "events").delete_result({"event_type": "error"}),
    "upsert_seeds": _seeded,
    "object_ids": _generated,
    "insert": _inserted,
    "insert_refuses": _clashes,
    "unique": _unique,
    "json_round_trip": _json_round_trip,
    "compact_copy": _rewritten,
    "mapped_rows": _mapped,
    "replace_upsert": _update("region", {"r_regionkey": 99}, {"r_name": "NEW"}, ("r_regionkey", "r_name"), upsert=True),
}

SQL = {
    "filter_eq": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'",
    "filter_eq_null": "SELECT o_orderkey FROM orders WHERE o_custkey = 7",
    "filter_ne": "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' OR o_orderstatus IS NULL",
    "filter_range": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_discount > 0.05::DOUBLE AND l_discount <= 0.07::DOUBLE",
    "filter_and": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 49.5 AND l_linenumber <= 2",
    "filter_date_range": "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'",
    "filter_type_bracket": "SELECT count(*) AS n FROM lineitem WHERE l_returnflag > 'N'",
    "filter_in": "SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#1', 'Brand#2')",
    "filter_nin": "SELECT p_partkey FROM part WHERE p_size NOT IN (1, 2, 3) OR p_size IS NULL",
    "filter_or": "SELECT event_id FROM events WHERE event_type = 'error' OR value > 90",
    "filter_nor": "SELECT event_id FROM events WHERE NOT (coalesce(event_type = 'error', false) OR coalesce(value > 90, false))",
    "filter_not": "SELECT event_id FROM events WHERE NOT coalesce(value > 50, false)",
    "filter_exists": "SELECT event_id FROM events WHERE value < 10",
    "filter_regex": "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '0{3}1[0-9]$')",
    "filter_regex_i": "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^SMALL', 'i')",
    "filter_type": "SELECT count(*) AS n FROM lineitem WHERE l_quantity >= 25",
    "filter_positional": "SELECT vec_id FROM embeddings WHERE embedding[1] > 0",
    "filter_array_any": "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x::DOUBLE > 0.25::DOUBLE)) > 0",
    "filter_elemmatch": "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x::DOUBLE > 0.1::DOUBLE AND x::DOUBLE < 0.11::DOUBLE)) > 0",
    "filter_size": "SELECT conv_id AS _id FROM conversations GROUP BY 1 HAVING count(*) = 4",
    "filter_nested_json": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) < 10",
    "project_include": "SELECT n_name, n_regionkey FROM nation",
    "project_exclude": "SELECT s_suppkey, s_name, s_nationkey FROM supplier",
    "project_slice": "SELECT vec_id, list_slice(embedding, 2, 4) AS embedding FROM embeddings",
    "project_slice_tail": "SELECT vec_id, list_slice(embedding, -2, -1) AS embedding FROM embeddings",
    "project_elemmatch": "SELECT vec_id, CASE WHEN len(list_filter(embedding, lambda x: x::DOUBLE > 0.2::DOUBLE)) > 0 THEN list_slice(list_filter(embedding, lambda x: x::DOUBLE > 0.2::DOUBLE), 1, 1) END AS embedding FROM embeddings",
    "sort_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "sort_skip_limit": "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 15 OFFSET 20",
    "count_filter": "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'",
    "find_by_id": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 42",
    "agg_match_group_sort": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 2) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "agg_group_null_key": "SELECT NULL::INTEGER AS _id, count(*) AS n, min(value) AS lo, max(value) AS hi FROM events HAVING count(*) > 0",
    "agg_sum_int": "SELECT l_returnflag AS _id, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY 1",
    "agg_first_last": "SELECT user_id AS _id, arg_min(event_type, (ts, event_id)) AS first, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY 1",
    "agg_push": "SELECT conv_id AS _id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY 1",
    "agg_unwind_group": "SELECT label AS _id, count(*) AS n, max(e)::DOUBLE AS mx FROM (SELECT label, unnest(embedding) AS e FROM embeddings) GROUP BY 1",
    "agg_count": "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O' HAVING count(*) > 0",
    "agg_skip_limit": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5 OFFSET 5",
    "agg_limit": "SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey LIMIT 3",
    "agg_having": "SELECT o_custkey AS _id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15",
    "agg_two_level": "SELECT n AS _id, count(*) AS orders FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1",
    "agg_literal_key": "SELECT o_orderstatus AS k, '$x' AS tag, count(*) AS n FROM orders GROUP BY 1",
    "update_set_inc": "SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN s_acctbal + 100 ELSE s_acctbal END AS s_acctbal, CASE WHEN s_nationkey < 5 THEN 'x' END AS flag FROM supplier",
    "update_mul_min_max": "SELECT p_partkey, p_retailprice * 2 AS p_retailprice, least(p_size, 20) AS p_size, 1 AS floor FROM part",
    "update_rename_unset": "SELECT n_nationkey, CASE WHEN n_regionkey <> 1 THEN n_name END AS n_name, CASE WHEN n_regionkey = 1 THEN n_name END AS title, CASE WHEN n_regionkey <> 1 THEN n_regionkey END AS n_regionkey FROM nation",
    "update_push": "SELECT vec_id, [0.5::FLOAT] AS embedding FROM embeddings",
    "update_pull_pop_addtoset": "WITH r AS (SELECT conv_id AS _id, list_filter(list(role ORDER BY turn), lambda x: x <> 'system')[2:] AS roles FROM conversations GROUP BY 1) SELECT _id, list_concat(CASE WHEN list_contains(roles, 'user') THEN roles ELSE list_append(roles, 'user') END, ['tool']) AS roles FROM r",
    "update_one": "SELECT min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'O' HAVING count(*) > 0",
    "delete_many": "SELECT event_id FROM events WHERE event_type <> 'error' OR event_type IS NULL",
    "delete_one": "SELECT r_regionkey FROM region WHERE r_regionkey <> 2",
    "replace_upsert": "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'NEW'",
    "find_ids": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (1, 2, 7, 33)",
    "find_key_range": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 200",
    "find_one": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1",
    "find_prepared": "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 45 OR l_returnflag = 'R' UNION ALL SELECT count(*) FROM lineitem WHERE l_linenumber = 1 AND (l_quantity > 45 OR l_returnflag = 'R')",
    "read_by_id": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 7",
    "visit": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY 1 LIMIT 3",
    "explain": "SELECT true AS pushed, true AS scans",
    "filter_all": "SELECT conv_id AS _id FROM conversations GROUP BY 1 HAVING bool_or(role = 'system') AND bool_or(role = 'assistant')",
    "filter_elemmatch_document": "SELECT DISTINCT l_orderkey AS _id FROM lineitem WHERE l_linenumber <= 2 AND l_quantity > 45 AND l_returnflag <> 'R'",
    "filter_fan_out": "SELECT l_orderkey AS _id FROM lineitem GROUP BY 1 HAVING bool_or(l_quantity >= 49) AND bool_or(l_returnflag = 'R')",
    "project_id": "SELECT n_nationkey, n_name FROM nation",
    "project_no_id": "SELECT n_name FROM nation",
    "project_positions": "SELECT vec_id, [embedding[1], embedding[3]] AS embedding FROM embeddings",
    "project_fan_out": "SELECT l_orderkey AS _id, count(*)::INTEGER AS n, max(l_linenumber) AS top FROM lineitem GROUP BY 1",
    "sort_nulls": "SELECT s_suppkey, CASE WHEN s_nationkey >= 3 THEN s_acctbal END AS s_acctbal FROM supplier ORDER BY 2 NULLS FIRST, 1 LIMIT 15",
    "agg_constants": "SELECT l_linestatus AS _id, 2 * count(*) AS two, 0.5::DOUBLE * count(*) AS half, 3.0::DOUBLE AS three, 0 AS none FROM lineitem GROUP BY 1",
    "agg_mixed_order": "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type DESC, value, event_id DESC) AS i, row_number() OVER (PARTITION BY user_id ORDER BY event_type, value DESC, event_id) AS j FROM events) SELECT user_id AS _id, max(CASE WHEN i = 1 THEN event_id END) AS first, max(CASE WHEN j = 1 THEN event_id END) AS last FROM r GROUP BY 1",
    "update_set_wider": "SELECT p_partkey, CASE WHEN p_size < 10 THEN 2.5 ELSE p_size END::DOUBLE AS p_size FROM part",
    "update_push_wider": "SELECT l_orderkey AS _id, (CASE WHEN bool_or(l_linenumber = 1) THEN greatest(2.5, max(l_linenumber)) ELSE max(l_linenumber) END)::DOUBLE AS top, (count(*) + bool_or(l_linenumber = 1)::INTEGER)::INTEGER AS n, (sum(l_linenumber) + CASE WHEN bool_or(l_linenumber = 1) THEN 2.5 ELSE 0 END)::DOUBLE AS total FROM lineitem GROUP BY 1",
    "update_inc_overflow": "SELECT p_partkey, p_size::BIGINT + CASE WHEN p_size >= 25 THEN 2147483647 ELSE 0 END AS p_size FROM part",
    "update_rename_dotted": "SELECT n_nationkey, CASE WHEN n_regionkey > 2 THEN n_name END AS name, CASE WHEN n_regionkey <= 2 THEN n_name END AS title, CASE WHEN n_regionkey > 2 THEN n_regionkey END AS old_region, CASE WHEN n_regionkey <= 2 THEN n_regionkey END AS region FROM nation",
    "update_creates_parents": "SELECT n_nationkey, CASE WHEN n_regionkey = 3 THEN 7 END AS zone, CASE WHEN n_regionkey = 3 THEN 't' END AS tag, n_name AS name FROM nation",
    "update_current_date": "SELECT r_regionkey, r_regionkey > 1 AS dated, r_regionkey > 1 AS recent FROM region",
    "update_result": "SELECT count(*) AS matched, count(*) FILTER (s_acctbal > 1000) AS modified, 0::BIGINT AS inserted FROM supplier WHERE s_nationkey <= 10",
    "update_result_replace": "SELECT 1::BIGINT AS matched, (r_name <> 'ASIA')::BIGINT AS modified, 0::BIGINT AS inserted FROM region WHERE r_regionkey >= 2 ORDER BY r_regionkey LIMIT 1",
    "update_result_upsert": "SELECT 0::BIGINT AS matched, 0::BIGINT AS modified, 1::BIGINT AS inserted",
    "delete_result": "SELECT count(*) AS deleted FROM events WHERE event_type = 'error'",
    "upsert_seeds": "SELECT n_nationkey, n_name AS name, n_regionkey::BIGINT AS region, NULL::INTEGER AS fresh, NULL::VARCHAR AS deeper FROM nation UNION ALL SELECT 99, 'NOWHERE', 4, 5, 'z'",
    "object_ids": "SELECT 2 * count(*) + 1 AS n, (count(*) + 1)::BIGINT AS generated, count(*) + 1 AS different, true AS dated FROM nation",
    "insert": "SELECT r_regionkey, r_name FROM region WHERE r_regionkey >= 3 UNION ALL VALUES (100, 'NORTH'), (101, NULL)",
    "insert_refuses": "SELECT * FROM (VALUES ('there', 1), ('null', 1), ('new', 0)) AS t(\"case\", refused)",
    "unique": "SELECT 'orders' AS what, count(*) = count(DISTINCT o_orderkey) AS is_unique FROM orders UNION ALL SELECT 'customers of orders', count(*) = count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'lines', count(*) = count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem",
    "json_round_trip": "SELECT event_id, value, props FROM events WHERE value >= 50",
    "compact_copy": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'",
    "mapped_rows": "SELECT s_suppkey, s_name, s_acctbal * 2 AS s_acctbal FROM supplier WHERE s_suppkey <= 20",
}
