"""Golden and rejection tables of the query language, on documents of one schema."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from vellum.collection import Collection, PreparedFilter
from vellum.errors import DuplicateKeyError, EngineError
from vellum.operators.pipeline import Pipeline

SCHEMA = "_id int, name string, mass double, crew long, fee decimal(10,2), port string, kinds array<string>, depths array<int>, berth struct<code:string,pos:struct<lat:double,lng:double>>, gear array<struct<what:string,count:int>>, seen timestamp"
SOON, LATER = (dt.datetime(2025, 3, d, 6, 30, tzinfo=dt.timezone.utc) for d in (2, 9))
NAN = float("nan")
BOATS = [
    (1, "Otter", 12.5, 40, Decimal("199.90"), "Cork", ["sail", "wood"], [3, 9], ("A1", (51.9, -8.5)), [("mast", 1), ("oar", 4)], SOON),
    (2, "heron", 7.0, 2**60 + 1, Decimal("0.30"), "Bergen", ["oar"], [15], ("B7", None), [("oar", 2)], SOON),
    (3, "Ørn", 7.0, -12, None, "Cork", [], [8, 30, 2], None, [], None),
    (4, "Kite", NAN, None, Decimal("55.00"), None, None, None, ("C3", (0.0, 0.0)), None, LATER),
    (5, "gull", 300.0, 40, Decimal("1.00"), None, ["wood", None], [21, 9], None, [("mast", 3), ("oar", None)], SOON),
    (6, "Auk", -1.5, 0, Decimal("7.25"), "Oslo", ["sail"], [], ("A1", None), None, LATER),
]

CASES = [
    ({}, "123456"), ({"mass": 7}, "23"), ({"mass": {"$gt": 7}}, "15"), ({"mass": {"$gte": 7.0, "$lt": 12.5}}, "23"), ({"mass": {"$lt": 1e9}}, "12356"), ({"mass": {"$gt": "7"}}, ""), ({"mass": {"$not": {"$gte": 7}}}, "46"), ({"mass": {"$type": "double"}}, "123456"),
    ({"mass": NAN}, "4"), ({"mass": {"$lte": NAN}}, "4"), ({"mass": {"$lt": NAN}}, ""), ({"keel": None}, "123456"), ({"keel": {"$exists": True}}, ""), ({"port": {"$exists": True}}, "123456"), ({"port": None}, "45"), ({"port": {"$ne": "Cork"}}, "2456"), ({"port": {"$in": ["Oslo", None]}}, "456"), ({"port": {"$type": "null"}}, "45"),
    ({"crew": {"$in": [40, 0]}}, "156"), ({"crew": {"$nin": [40, 0]}}, "234"), ({"crew": {"$in": []}}, ""), ({"crew": 2**60}, ""), ({"crew": 2**60 + 1}, "2"), ({"crew": {"$gt": float(2**60)}}, "2"), ({"crew": {"$lte": 39.5}}, "36"), ({"crew": 39.5}, ""), ({"crew": {"$lt": 1e308}}, "12356"), ({"crew": {"$lte": None}}, "4"),
    ({"fee": 0.3}, ""), ({"fee": Decimal("0.3")}, "2"), ({"fee": 7.25}, "6"), ({"fee": {"$gt": 55}}, "1"), ({"fee": {"$lt": 0.3}}, ""), ({"fee": {"$gt": 0.3, "$lte": 1}}, "25"),
    ({"kinds": "wood"}, "15"), ({"kinds": ["oar"]}, "2"), ({"kinds": []}, "3"), ({"kinds": {"$size": 1}}, "26"), ({"kinds": None}, "45"), ({"kinds": {"$all": ["wood", "sail"]}}, "1"), ({"kinds": {"$all": []}}, ""), ({"kinds": {"$ne": "sail"}}, "2345"), ({"kinds": {"$type": "string"}}, "1256"), ({"kinds": {"$type": 4}}, "12356"), ({"kinds.x": None}, "4"),
    ({"depths.0": 3}, "1"), ({"depths.1": 9}, "15"), ({"depths": {"$gt": 10, "$lt": 5}}, "3"), ({"depths": {"$elemMatch": {"$gt": 8, "$lt": 20}}}, "125"), ({"depths.7": None}, "4"),
    ({"berth.code": "A1"}, "16"), ({"berth.pos.lat": 0}, "4"), ({"berth.pos.lat": None}, "2356"), ({"berth": {"code": "B7", "pos": None}}, "2"), ({"berth": {"pos": None, "code": "B7"}}, ""),
    ({"gear.what": "oar"}, "125"), ({"gear.count": {"$gte": 3}}, "15"), ({"gear": {"$elemMatch": {"what": "oar", "count": {"$gt": 2}}}}, "1"), ({"gear.1.what": "oar"}, "15"), ({"gear.count": None}, "456"), ({"gear": {"what": "mast", "count": 3}}, "5"),
    ({"name": {"$regex": "^[A-Z]"}}, "146"), ({"name": {"$regex": "ø", "$options": "i"}}, "3"), ({"kinds": {"$regex": "^s"}}, "16"), ({"seen": {"$lte": SOON}}, "125"), ({"seen": {"$lt": SOON}}, ""),
    ({"$or": [{"mass": 7}, {"port": "Oslo"}]}, "236"), ({"$nor": [{"mass": 7}, {"port": "Oslo"}]}, "145"), ({"$and": [{"mass": 7}, {"port": "Cork"}]}, "3"), ({"a": {"b": 1, "$gt": 2}}, ""),
]

BAD_FILTERS = [{"$x": 1}, {"": 1}, {"a": {"$gt": 1, "b": 2}}, {"a": {"$foo": 1}}, {"$and": []}, {"$or": {}}, {"name": {"$in": 3}}, {"name": {"$all": 3}}, {"name": {"$size": "x"}}, {"name": {"$type": "number"}}, {"name": {"$regex": "a", "$options": "q"}}, {"name": {"$not": 3}}, {"name": {"$elemMatch": 3}}, {"name": {"$type": ["int"]}}, {"nope": {"$elemMatch": {"$foo": 1}}}]
BAD_PROJECTIONS = [{"name": 1, "mass": 0}, {"berth": 1, "berth.code": 1}, {"name": "$mass"}, {"name": {"$concat": ["a"]}}, {"a..b": 1}, {"depths.1": 1, "depths.01": 1}, {"depths": {"$slice": [1, 0]}}, {"depths": {"$slice": "x"}}, {"berth.gear": {"$elemMatch": {"a": 1}}}]
BAD_STAGES = [{}, {"$match": {}, "$limit": 1}, {"$lookup": {}}, {"$limit": -1}, {"$skip": 1.5}, {"$count": ""}, {"$count": "a.b"}, {"$unwind": "tags"}, {"$group": {"n": {"$sum": 1}}}, {"$sort": {"a": 2}}, {"$sort": {}}, {"$sort": {"a..b": 1}}, {"$match": {"$foo": 1}}, {"$group": {"_id": 1, "n": {"$median": "$a"}}}, {"$group": {"_id": 1, "n": {"$count": 1}}}, {"$project": {"a": 1, "b": 0}}]
BAD_UPDATES = [{"$set": {"_id": 1}}, {"$set": {}}, {"$foo": {"a": 1}}, {"a": 1, "$set": {"b": 1}}, {"$inc": {"n": "x"}}, {"$rename": {"name": "_id"}}, {"$set": {"crew": "many"}}, {"$push": {"depths": "deep"}}, {"$set": {"name.first": 1}}]


@pytest.fixture(scope="module")
def boats(spark):
    return Collection(spark.createDataFrame(BOATS, SCHEMA), "_id")


def ids(df):
    return "".join(str(r["_id"]) for r in sorted(df.collect(), key=lambda r: r["_id"]))


def test_filters(boats):
    """All cases in one plan: a column per case."""
    flags = boats.df.select("_id", *[F.coalesce(PreparedFilter(spec)(boats.df.schema), F.lit(False)).alias(f"c{i}") for i, (spec, _) in enumerate(CASES)]).collect()
    got = [(spec, "".join(str(r["_id"]) for r in flags if r[f"c{i}"])) for i, (spec, _) in enumerate(CASES)]
    assert [(a, b) for (a, b), (_, want) in zip(got, CASES, strict=True) if b != want] == []


@pytest.mark.parametrize("spec", BAD_FILTERS, ids=str)
def test_bad_filters(boats, spec):
    with pytest.raises(EngineError):
        boats.find(spec)
    with pytest.raises(EngineError):
        PreparedFilter(spec)


@pytest.mark.parametrize("spec", BAD_PROJECTIONS, ids=str)
def test_bad_projections(boats, spec):
    with pytest.raises(EngineError):
        boats.find({}, spec)


@pytest.mark.parametrize("stage", BAD_STAGES, ids=str)
def test_bad_stages(boats, stage):
    with pytest.raises(EngineError):
        Pipeline([stage])


@pytest.mark.parametrize("update", BAD_UPDATES, ids=str)
def test_bad_updates(boats, update):
    with pytest.raises(EngineError):
        boats.update({}, update)


def test_projection(boats):
    one = lambda spec: boats.find({"_id": 1}, spec).first().asDict(True)
    assert one({"port": 1, "berth.pos.lat": 1}) == {"_id": 1, "port": "Cork", "berth": {"pos": {"lat": 51.9}}}
    assert one({"_id": 1}) == {"_id": 1} and one({"gear.what": 1, "_id": 0}) == {"gear": [{"what": "mast"}, {"what": "oar"}]}
    assert one({"depths.1": 1, "_id": 0}) == {"depths": [9]} and one({"depths.1": 0})["depths"] == [3]
    assert one({"gear": {"$elemMatch": {"count": {"$gt": 1}}}}) == {"_id": 1, "gear": [{"what": "oar", "count": 4}]}
    assert one({"depths": {"$slice": -1}, "_id": 0, "crew": 1}) == {"crew": 40, "depths": [9]} and one({"depths": {"$slice": [-9, 1]}})["depths"] == [3]
    assert "berth" not in one({"berth": 0}) and one({"berth.pos": 0})["berth"] == {"code": "A1"} and one({"gear.count": 0})["gear"][1] == {"what": "oar"}


def test_the_key_has_any_name(boats):
    named = Collection(boats.df.withColumnRenamed("_id", "hull"), "hull")
    assert named.find({}, {"name": 1}).columns == ["hull", "name"] and named.find({}, {"name": 1, "hull": 0}).columns == ["name"] == named.find({}, {"name": 1, "_id": 0}).columns
    assert named.aggregate([{"$project": {"name": 1}}]).columns == ["hull", "name"]


def test_sort_and_window(boats):
    order = lambda sort, **k: [r["_id"] for r in boats.find({}, {"_id": 1}, sort=sort, **k).collect()]
    assert order({"mass": 1}) == [4, 6, 2, 3, 1, 5] and order({"mass": -1}) == [5, 1, 2, 3, 6, 4]
    assert order({"port": 1, "_id": -1}) == [5, 4, 2, 3, 1, 6] and order({"mass": 1}, skip=1, limit=3) == [6, 2, 3] and order(None, limit=0) == [1, 2, 3, 4, 5, 6]
    seen = []
    assert boats.visit({}, lambda r: (seen.append(r["_id"]), len(seen) < 4)[1]) == 4 and seen == [1, 2, 3, 4]
    assert boats.count({"mass": 7}) == 2 and boats.read_by_id(4, lambda r: r["name"]) == "Kite" and boats.read_by_id(9, lambda r: r["name"]) is None


def test_pipeline(boats):
    run = lambda *s: [r.asDict(True) for r in boats.aggregate(list(s)).collect()]
    made = {"n": {"$count": {}}, "s": {"$sum": "$crew"}, "a": {"$avg": "$crew"}, "lo": {"$min": "$mass"}, "hi": {"$max": "$mass"}, "one": {"$sum": 1}, "none": {"$sum": "$name"}, "names": {"$push": "$name"}, "f": {"$first": "$crew"}, "l": {"$last": "$name"}}
    stats = {r["_id"]: r for r in run({"$group": {"_id": "$port"} | made})}
    assert stats["Cork"] == {"_id": "Cork", "n": 2, "s": 28, "a": 14.0, "lo": 7.0, "hi": 12.5, "one": 2, "none": 0, "names": ["Otter", "Ørn"], "f": 40, "l": "Ørn"}
    assert stats[None]["hi"] == 300.0 and stats[None]["lo"] != stats[None]["lo"] and stats[None]["f"] is None and stats[None]["names"] == ["Kite", "gull"]
    assert run({"$match": {"_id": 99}}, {"$group": {"_id": None, "n": {"$count": {}}}}) == [] == run({"$match": {"_id": 99}}, {"$count": "n"}) and run({"$count": "n"}) == [{"n": 6}]
    assert sorted((r["kinds"] or "") for r in run({"$unwind": "$kinds"}, {"$project": {"kinds": 1}})) == ["", "oar", "sail", "sail", "wood", "wood"]
    assert [r["_id"] for r in run({"$sort": {"mass": -1}}, {"$skip": 1}, {"$limit": 2}, {"$project": {"name": 1}})] == [1, 2] and run({"$limit": 0}) == []
    for keys, want in (({"port": -1, "_id": 1}, [6, 1, 3, 2, 4, 5]), ({"crew": -1, "_id": 1}, [2, 1, 5, 6, 3, 4]), ({"mass": -1, "_id": 1}, [5, 1, 2, 3, 6, 4]), ({"fee": -1, "_id": 1}, [1, 4, 6, 5, 2, 3]), ({"seen": -1, "_id": 1}, [4, 6, 1, 2, 5, 3])):
        assert run({"$sort": keys}, {"$group": {"_id": None, "all": {"$push": "$_id"}, "f": {"$first": "$_id"}}}) == [{"_id": None, "all": want, "f": want[0]}]
    assert [r["_id"] for r in run({"$unwind": "$gear"}, {"$match": {"gear.count": {"$gt": 1}}}, {"$sort": {"gear.count": -1}})] == [1, 5, 2]
    assert run({"$group": {"_id": None, "a": {"$sum": {"$literal": 2}}, "b": {"$sum": Decimal("1.5")}, "c": {"$avg": {"$literal": 2}}, "d": {"$sum": True}, "e": {"$sum": 0.5}}}) == [{"_id": None, "a": 12, "b": Decimal("9.0"), "c": 2.0, "d": 0, "e": 3.0}]


def test_a_filter_alone_is_not_sorted(boats):
    plan = boats.aggregate([{"$match": {"mass": 7}}, {"$project": {"name": 1}}])._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_updates(boats):
    def after(update, spec={"_id": 1}, key=1, **k):
        return boats.update(spec, update, **k).find({"_id": key}).first().asDict(True)

    assert after({"$set": {"name": "X", "berth.code": "9"}})["berth"]["code"] == "9" and after({"$inc": {"crew": 2, "new": 4}})["crew"] == 42 and after({"$inc": {"new": 4}})["new"] == 4
    assert after({"$mul": {"crew": 2.5}})["crew"] == 100 and after({"$min": {"mass": 3}, "$max": {"crew": 99}})["mass"] == 3.0
    assert after({"$push": {"kinds": {"$each": ["x", "sail"]}}})["kinds"] == ["sail", "wood", "x", "sail"] and after({"$addToSet": {"kinds": {"$each": ["x", "sail"]}}})["kinds"] == ["sail", "wood", "x"]
    assert after({"$pull": {"kinds": "sail"}})["kinds"] == ["wood"] and after({"$pop": {"depths": 1}})["depths"] == [3] and after({"$pop": {"depths": -1}})["depths"] == [9]
    assert after({"$unset": {"port": 1}})["port"] is None and after({"$rename": {"port": "town"}})["town"] == "Cork" and after({"$currentDate": {"seen": True}})["seen"].year > 2025
    assert after({"name": "R"})["name"] == "R" and after({"name": "R"})["port"] is None
    assert after({"$set": {"crew": 2.5}})["crew"] == 2.5 and after({"$push": {"depths": 2.5}})["depths"] == [3, 9, 2.5] and after({"$set": {"fee": 1.5}})["fee"] == Decimal("1.50")
    assert after({"$inc": {"depth": 2**31 - 1}})["depth"] == 2**31 - 1 and boats.update({}, {"$set": {"k": 2**31 - 1}}).update({}, {"$inc": {"k": 1}}).df.first()["k"] == 2**31
    moved = after({"$rename": {"berth.pos.lat": "berth.north", "berth.code": "code"}})
    assert (moved["berth"], moved["code"]) == ({"code": None, "pos": {"lat": None, "lng": -8.5}, "north": 51.9}, "A1")
    assert after({"$set": {"berth.pos.lat": 1.0}}, {"_id": 3}, 3)["berth"] == {"code": None, "pos": {"lat": 1.0, "lng": None}} and after({"$set": {"a.b.c": 1}})["a"] == {"b": {"c": 1}}
    assert ids(boats.update({"mass": 7}, {"$set": {"name": "Z"}}, one=True).find({"name": "Z"})) == "2" and ids(boats.delete({"mass": 7}).df) == "1456" and ids(boats.delete({"mass": 7}, one=True).df) == "13456"
    assert boats.update({"_id": 1}, {"$set": {"mass": 1.0}}, upsert=True).count() == 6


def test_results_of_updates(boats):
    result = lambda *a, **k: tuple(boats.update_result(*a, **k).first())
    assert result({"mass": 7}, {"$set": {"port": "Cork"}}) == (2, 1, 0) and result({"mass": 7}, {"$inc": {"crew": 1}}, one=True) == (1, 1, 0) and result({"_id": 9}, {"$set": {"port": "X"}}, upsert=True) == (0, 0, 1)
    assert result({"_id": 3}, {"name": "N"}) == (1, 1, 0) and result({"_id": 9}, {"name": "N"}) == (0, 0, 0) and boats.delete_result({"mass": 7}).first()[0] == 2 and boats.delete_result({"mass": 7}, one=True).first()[0] == 1


def test_upserts(spark, boats):
    new = boats.update({"_id": 9, "name": "N", "berth.code": {"$eq": "Q"}, "fresh": 5, "crew": {"$gt": 3}}, {"$set": {"mass": 1.0}}, upsert=True).find({"_id": 9}).first().asDict(True)
    assert (new["name"], new["berth"], new["fresh"], new["mass"], new["crew"]) == ("N", {"code": "Q", "pos": None}, 5, 1.0, None)
    with pytest.raises(EngineError):
        boats.update({"name": "nobody"}, {"$set": {"mass": 1.0}}, upsert=True)
    made = Collection(spark.createDataFrame([("a", 1)], "_id string, n int"), "_id").update({"n": 2}, {"$inc": {"n": 1}}, upsert=True).find({"n": 3}).collect()
    assert len(made) == 1 and len(made[0]["_id"]) == 24


def test_insert_and_unique(spark, boats):
    assert ids(boats.insert(spark.createDataFrame([Row(_id=7, name="G")], "_id int, name string")).df) == "1234567"
    with pytest.raises(DuplicateKeyError):
        boats.insert(spark.createDataFrame([Row(_id=1)], "_id int"))
    for bad in ([(None, "x")], "_id int, name string"), ([("x",)], "name string"):
        with pytest.raises(EngineError):
            boats.insert(spark.createDataFrame(*bad))
    with pytest.raises(EngineError):
        Collection(boats.df).update({}, {"$set": {"name": "x"}}, one=True)
    assert boats.is_unique("name") and not boats.is_unique("mass")


def test_json_round_trip(spark, boats, tmp_path):
    from vellum.sources.tables import export_json, import_json, rewrite

    export_json(boats.df.drop("mass"), str(tmp_path / "x"))
    back = import_json(spark, str(tmp_path / "x"), boats.df.drop("mass").schema, "_id")
    assert back.df.exceptAll(boats.df.drop("mass")).isEmpty()
    (tmp_path / "relaxed.json").write_text("[{_id: 1, 'name': 'q'}, // note\n {_id: 2}]")
    assert import_json(spark, str(tmp_path / "relaxed.json"), "_id int, name string", "_id", array=True).count() == 2
    assert rewrite(boats, str(tmp_path / "copy")).count() == 6


def test_streaming_and_mapping(spark, tmp_path):
    import dataclasses

    from vellum.mapping import from_rows, schema_of, to_row
    from vellum.streaming.live import live_find

    @dataclasses.dataclass
    class Point:
        point_id: int
        tags: list[str]
        note: str | None = None

    rows = [to_row(Point(1, ["a"])), to_row(Point(2, ["b"], "x"))]
    df = spark.createDataFrame(rows, schema_of(Point))
    assert from_rows(df.collect(), Point) == [Point(1, ["a"]), Point(2, ["b"], "x")]
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = live_find(stream, {"tags": "b"}, {"pointId": 1, "note": 1}).writeStream.format("memory").queryName("live").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("live").collect()] == [(2, "x")]


def test_pushdown(spark):
    from vellum.sources.tables import parquet

    plan = parquet(spark, "/root/testdata/sf0.001/lineitem.parquet").find({"l_quantity": {"$gt": 49}, "l_returnflag": {"$in": ["A", "R"]}}, {"l_orderkey": 1, "_id": 0})._jdf.queryExecution().toString()
    assert "GreaterThan(l_quantity,49" in plan and "In(l_returnflag" in plan and "l_tax" not in plan.split("== Physical Plan ==")[1]


def test_pushes_to_more_than_a_million_groups(spark, tmp_path):
    from vellum.queries import QUERIES

    spark.range(10**6 + 7).selectExpr("id AS l_orderkey", "1 AS l_linenumber").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = QUERIES["update_push_wider"](spark, str(tmp_path)).agg(F.count("_id"), F.sum("n"), F.sum("total"), F.min("top")).first()
    assert tuple(found) == (10**6 + 7, 2 * (10**6 + 7), 3.5 * (10**6 + 7), 2.5)
