"""Selectors against expected matches, on VARIANT bodies and typed columns, and against a plain evaluator."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakedoc.functions.fields import Fields
from lakedoc.functions.selector import matches
from lakedoc.operators.collection import Collection


def matching(spark, selector, docs):
    """Which of the JSON documents match, in order."""
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, text string").withColumn("body", F.parse_json("text"))
    hit = {r[0] for r in rows.where(matches(selector, Fields(rows.drop("i", "text"), "body"))).select("i").collect()}
    return [i in hit for i in range(len(docs))]


MISSING = object()

CASES = [
    # operator, field, argument, expected
    ("$lt", 1, 2, True), ("$lt", 2, 2, False), ("$lt", 1.5, 2, True), ("$lt", 2, 2.0, False), ("$lt", "a", "b", True), ("$lt", "1", 2, False), ("$lt", True, 2, False),
    ("$lte", 1, 2, True), ("$lte", 2, 2, True), ("$lte", 3, 2, False), ("$lte", None, None, True), ("$lte", [1], [1], True),
    ("$eq", None, None, True), ("$eq", None, 123, False), ("$eq", 123, 123, True), ("$eq", 124, 123, False), ("$eq", 2, 2.0, True), ("$eq", "123", "123", True), ("$eq", "123", 123, False), ("$eq", True, True, True),
    ("$eq", True, 1, False), ("$eq", [1, 2], [1, 2], True), ("$eq", [1, 2], [2, 1], False), ("$eq", {"a": 1, "b": "x"}, {"b": "x", "a": 1}, True), ("$eq", MISSING, None, True),
    ("$ne", 123, 123, False), ("$ne", 124, 123, True), ("$ne", MISSING, 123, True), ("$ne", "x", 123, True),
    ("$gte", 3, 2, True), ("$gte", 2, 2, True), ("$gte", 1, 2, False), ("$gt", 3, 2, True), ("$gt", 2, 2, False), ("$gt", 3, 2.5, True), ("$gt", "b", "a", True), ("$gt", [3], [2], False),
    ("$exists", 1, True, True), ("$exists", MISSING, True, False), ("$exists", MISSING, False, True), ("$exists", None, True, False),
    ("$type", True, "boolean", True), ("$type", 3.1, "number", True), ("$type", 3, "number", True), ("$type", "x", "string", True), ("$type", [], "array", True), ("$type", {}, "object", True), ("$type", None, "null", True), ("$type", MISSING, "null", True), ("$type", 3, "string", False),
    ("$in", 1, [], False), ("$in", 1, [1], True), ("$in", 1, [2, 1], True), ("$in", None, [], False), ("$in", "Test", [2, "Test"], True), ("$in", [1], [1], False), ("$in", MISSING, [None], True),
    ("$nin", 1, [], True), ("$nin", 1, [1], False), ("$nin", MISSING, [], True), ("$nin", "Test", [2, "Test"], False), ("$nin", MISSING, [1], True),
    ("$size", [], 0, True), ("$size", [1], 0, False), ("$size", [1], 1, True), ("$size", [1, 2], 2, True), ("$size", 0, 0, False), ("$size", "ab", 2, False),
    ("$mod", 0, [1, 1], False), ("$mod", MISSING, [1, 1], False), ("$mod", 1, [1, 0], True), ("$mod", 1.5, [1, 0], False), ("$mod", 235, [7, 4], True), ("$mod", -7, [4, -3], True), ("$mod", "7", [7, 0], False),
    ("$regex", 0, "0", False), ("$regex", "0", "0", True), ("$regex", "0000", "0{4}", True), ("$regex", "xaby", "ab", True), ("$regex", MISSING, ".*", False),
    ("$all", [1, 2, 3], [2, 1], True), ("$all", [1], [1, 2], False), ("$all", ["a", 1], ["a"], True), ("$all", [], [], False), ("$all", "a", ["a"], False),
    ("$elemMatch", [1, 5], {"$gt": 4}, True), ("$elemMatch", [1, 3], {"$gt": 4}, False), ("$allMatch", [5, 6], {"$gt": 4}, True), ("$allMatch", [5, 3], {"$gt": 4}, False), ("$allMatch", [], {"$gt": 4}, False),
]


def test_operators(spark):
    rows = [(i, json.dumps({} if f is MISSING else {"f": f})) for i, (_, f, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, text string").withColumn("body", F.parse_json("text"))
    fields = Fields(df.drop("i", "text"), "body")
    cond = F.lit(None).cast("boolean")
    for i, (op, _, arg, _) in enumerate(CASES):
        cond = F.when(F.col("i") == i, matches({"f": {op: arg}}, fields)).otherwise(cond)
    got = {r[0]: r[1] for r in df.select("i", F.coalesce(cond, F.lit(False))).collect()}
    bad = [(c, got[i]) for i, c in enumerate(CASES) if got[i] != c[3]]
    assert not bad


MOVIES = [
    {"title": "A", "year": 2001, "director": "X", "genre": ["drama", "war"], "info": {"country": "PL"}},
    {"title": "B", "year": 2010, "director": "Y", "genre": ["comedy"], "info": {"country": "DE"}},
    {"title": "C", "year": 1994, "director": "X", "genre": []},
]


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ({}, [False, False, False]),
        ({"director": "X"}, [True, False, True]),
        ({"director": "X", "year": {"$gt": 2000}}, [True, False, False]),
        ({"$and": [{"director": "X"}, {"year": {"$lt": 2000}}]}, [False, False, True]),
        ({"$or": [{"title": "B"}, {"year": 1994}]}, [False, True, True]),
        ({"$not": [{"director": "X"}]}, [False, True, False]),
        ({"$not": {"director": "X"}}, [False, True, False]),
        ({"$nor": [{"year": 2001}, {"year": 2010}]}, [False, False, True]),
        ({"year": {"$gte": 1900, "$lte": 2001}, "$or": [{"title": "A"}, {"$and": [{"title": "C"}]}]}, [True, False, True]),
        ({"genre": {"$all": ["war", "drama"]}}, [True, False, False]),
        ({"info.country": "PL"}, [True, False, False]),
        ({"info": {"country": "PL"}}, [True, False, False]),
        ({"info": {"country": {"$in": ["PL", "DE"]}}}, [True, True, False]),
        ({"info.country": {"$ne": "PL"}}, [False, True, True]),
        ({"info..country": None}, [True, True, True]),
    ],
)
def test_groups_and_paths(spark, selector, want):
    assert matching(spark, selector, MOVIES) == want


@pytest.mark.parametrize("selector", [{"a": {"$foo": 1}}, {"$foo": []}, {"a": {"$mod": [0, 1]}}, {"a": {"$mod": [1.0, 0]}}, {"a": {"$mod": "x"}}, {"a": {"$in": 3}}, {"a": {"$size": "x"}}, {"a": {"$regex": 0}}, {"a": {"$type": "int"}}, {"$and": 3}, {"a": {"$gt": 1, "b": 2}}])
def test_errors(spark, selector):
    with pytest.raises(ValueError):
        matches(selector, Fields(spark.createDataFrame([("{}",)], "text string").select(F.parse_json("text").alias("body")), "body"))


def kind(v):
    return "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array"


def plain(selector, doc):
    """The same rules, evaluated in Python."""

    def one(op, v, arg):
        same = kind(v) == kind(arg)
        if op == "$eq":
            return same and v == arg
        if op == "$ne":
            return not one("$eq", v, arg)
        if op in ("$lt", "$gt"):
            return same and kind(v) in ("number", "string") and (v < arg if op == "$lt" else v > arg)
        if op in ("$lte", "$gte"):
            return one("$eq", v, arg) or one({"$lte": "$lt", "$gte": "$gt"}[op], v, arg)
        if op == "$in":
            return any(one("$eq", v, x) for x in arg)
        return not one("$in", v, arg)

    def member(k, v):
        if k == "$and":
            return all(plain(x, doc) for x in v)
        if k == "$or":
            return any(plain(x, doc) for x in v)
        if k == "$nor":
            return not any(plain(x, doc) for x in v)
        if k == "$not":
            return not plain(v[0], doc)
        (op, arg), = v.items()
        return one(op, doc.get(k), arg)

    return all(member(k, v) for k, v in selector.items()) if selector else False


scalar = st.one_of(st.none(), st.booleans(), st.integers(-3, 3), st.sampled_from([0.5, 2.0]), st.sampled_from(["", "a", "b", "1"]))
leaf = st.builds(lambda f, op, a, l: {f: {op: l if op in ("$in", "$nin") else a}}, st.sampled_from(["a", "b"]), st.sampled_from(["$eq", "$ne", "$lt", "$lte", "$gt", "$gte", "$in", "$nin"]), scalar, st.lists(scalar, max_size=3))
tree = st.recursive(leaf, lambda t: st.one_of(st.builds(lambda k, x: {k: x}, st.sampled_from(["$and", "$or", "$nor"]), st.lists(t, min_size=1, max_size=3)), st.builds(lambda x: {"$not": [x]}, t)), max_leaves=5)
DOCS = [{"a": a, "b": b} for a in (None, True, 1, 2.0, "a") for b in (False, -3, "b", "1")] + [{}, {"a": 0.5}]


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(selector=tree)
def test_like_plain_evaluation(spark, selector):
    assert matching(spark, selector, DOCS) == [plain(selector, d) for d in DOCS]


def test_typed_columns_push_down(spark, sf):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    c = Collection.from_table(spark.read.parquet(f"{sf}/orders.parquet"), "orders", ["o_orderkey"])
    plan = c.find({"o_orderstatus": "F", "o_totalprice": {"$gt": 100000}}, fields=["o_orderkey"], limit=None)._jdf.queryExecution().toString()
    assert "GreaterThan(o_totalprice,100000.0)" in plan and "EqualTo(o_orderstatus,F)" in plan
    assert "o_orderpriority" not in plan[plan.rindex("ReadSchema") :]


def test_explain_chooses_an_index(spark):
    c = Collection(spark.createDataFrame([("1", 2)], "_id string, a int"), indexes=[{"name": "by_a", "fields": ["a"]}])
    assert c.explain({"a": 2})["index"]["name"] == "by_a"
    assert c.explain({"a": {"$gt": 2}})["index"]["name"] == "_all_docs"
