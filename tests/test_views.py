"""Views over small collections: keys, ranges, groups and reducers, and the cases at their edges."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakedoc.functions.collation import mixed_array_key, mixed_key
from lakedoc.operators.collection import Collection
from lakedoc.operators.views import Emit, GroupedReduce, View


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def names(spark):
    return Collection(spark.createDataFrame([(f"d{i}", n) for i, n in enumerate(["bb", "elephant", "a", "d", "cat", None])], "_id string, name string"))


def by_name(**k):
    return View([Emit(F.col("name"))], **k)


def test_order_and_nulls_first(names):
    assert [r.k0 for r in by_name().query(names).collect()] == [None, "a", "bb", "cat", "d", "elephant"]
    assert [r.k0 for r in by_name().query(names, descending=True).collect()] == ["elephant", "d", "cat", "bb", "a", None]


@pytest.mark.parametrize(
    ("options", "want"),
    [
        ({"startkey": "bb", "endkey": "d"}, ["bb", "cat", "d"]),
        ({"startkey": "bb", "endkey": "d", "inclusive_end": False}, ["bb", "cat"]),
        ({"startkey": "d", "endkey": "bb", "descending": True}, ["d", "cat", "bb"]),
        ({"startkey": "d", "endkey": "bb", "descending": True, "inclusive_end": False}, ["d", "cat"]),
        ({"key": "cat"}, ["cat"]),
        ({"key": (None,)}, [None]),
        ({"keys": ["d", "x", "a"]}, ["a", "d"]),
        ({"endkey": "a"}, [None, "a"]),
        ({"startkey": 5}, ["a", "bb", "cat", "d", "elephant"]),
        ({"endkey": 5}, [None]),
        ({"startkey": ["x"]}, []),
        ({"skip": 2, "limit": 2}, ["bb", "cat"]),
        ({"startkey_docid": "d3"}, [None, "cat", "d"]),
    ],
)
def test_ranges(names, options, want):
    assert [r.k0 for r in by_name().query(names, **options).collect()] == want


@pytest.fixture
def hosts(spark):
    data = [("1", "linux", "web", "a", 1), ("2", "linux", "web", "b", 2), ("3", "linux", "db", "c", 3), ("4", "bsd", "web", "d", 4)]
    return Collection(spark.createDataFrame(data, "_id string, os string, cat string, host string, v int"))


def test_group_levels(hosts):
    view = View([Emit([F.col("os"), F.col("cat"), F.col("host")], F.col("v"))], "_sum")
    assert rows(view.query(hosts, group_level=1)) == [("bsd", 4), ("linux", 6)]
    assert rows(view.query(hosts, group_level=2)) == [("bsd", "web", 4), ("linux", "db", 3), ("linux", "web", 3)]
    assert rows(view.query(hosts, group_level=9)) == rows(view.query(hosts, group=True))
    assert rows(view.query(hosts)) == [(10,)]
    assert rows(view.query(hosts, startkey=["linux"], endkey=["linux", {}], group_level=1)) == [("linux", 6)]
    assert rows(view.query(hosts, startkey=["linux", "web"], group_level=2)) == [("linux", "web", 3)]


def test_no_rows_no_group(hosts):
    view = View([Emit(F.col("os"), F.col("v"))], "_count")
    assert rows(view.query(hosts, key="none")) == []
    assert rows(view.query(hosts, key="none", group=True)) == []


def test_stats_and_count(spark):
    c = Collection(spark.createDataFrame([("1", 1), ("2", 2), ("3", 3)], "_id string, v int"))
    assert rows(View([Emit(F.lit("x"), F.col("v"))], "_stats").query(c)) == [(6.0, 1.0, 3.0, 3, 14.0)]


@pytest.mark.parametrize(
    ("kind", "values", "want"),
    [
        ("array<long>", [[1, 2, 3], [4, 5, 6]], [5, 7, 9]),
        ("array<long>", [[1, 2, 3], [4, 5]], [5, 7, 3]),
        ("array<double>", [[1.5, 2.0], [2.5, 3.0]], [4.0, 5.0]),
        ("long", [10, 5], 15),
        ("double", [10.0, 0.5], 10.5),
        ("string", ["10", "x"], 10.0),
    ],
)
def test_sums(spark, kind, values, want):
    c = Collection(spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], f"_id string, v {kind}"))
    assert rows(View([Emit(F.lit("k"), F.col("v"))], "_sum").query(c)) == [(want,)]
    assert rows(View([Emit(F.lit("k"), F.col("v"))], "_sum").query(c, group=True)) == [("k", want)]


def test_multi_emit_and_conditions(spark):
    c = Collection(spark.createDataFrame([("1", ["a", "b"], 1), ("2", [], 2), ("3", None, 3)], "_id string, tags array<string>, v int"))
    view = View([Emit(lambda t: t, each=F.col("tags")), Emit(F.lit("big"), when=F.col("v") > 1)])
    assert sorted((r.id, r.k0) for r in view.query(c).collect()) == [("1", "a"), ("1", "b"), ("2", "big"), ("3", "big")]


def test_design_local_and_deleted_documents_are_not_mapped(spark):
    c = Collection(spark.createDataFrame([("1", False), ("2", True), ("_design/x", False), ("_local/y", None), ("3", None)], "_id string, _deleted boolean"))
    assert [r.id for r in View([Emit(F.lit(1))]).query(c).collect()] == ["1", "3"]


def test_approximate_distinct(spark):
    c = Collection(spark.range(20000).select(F.col("id").cast("string").alias("_id"), (F.col("id") % 10000).alias("k")))
    got = View([Emit(F.col("k"))], "_approx_count_distinct").query(c).first()[0]
    assert abs(got - 10000) < 500


def test_custom_reduce(hosts):
    import pandas as pd

    how = GroupedReduce(lambda key, f: pd.DataFrame([[*key, int(f["value"].prod())]]), "product long", gathers=True)
    assert rows(View([Emit(F.col("os"), F.col("v"))], how).query(hosts, group=True)) == [("bsd", 4), ("linux", 6)]
    with pytest.raises(ValueError, match="gathers"):  # the whole table in one call
        View([Emit(F.col("os"), F.col("v"))], how).query(hosts)
    with pytest.raises(ValueError, match="gathers"):
        View([Emit(F.col("os"), F.col("v"))], GroupedReduce(how.final, how.schema)).query(hosts, group=True)


def test_mixed_keys_sort_in_collation_order(spark):
    texts = ['"a"', "null", "2", "true", "[1]", "10", "false", '{"a":1}', "1.5", '"B"', "[1,2]", "[0]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("v", F.parse_json("t"))
    got = [r.t for r in df.orderBy(mixed_key(F.col("v")), mixed_array_key(F.col("v"))).collect()]
    assert got == ["null", "false", "true", "1.5", "2", "10", '"B"', '"a"', "[0]", "[1]", "[1,2]", '{"a":1}']


def test_include_docs_and_types(names):
    got = by_name().query(names, key="cat", include_docs=True)
    assert got.first().doc["name"] == "cat"
    assert isinstance(got.schema["doc"].dataType, T.StructType)


def test_find_pages_and_defaults(spark):
    c = Collection(spark.createDataFrame([(f"x{i:03}", i) for i in range(60)], "_id string, n int"))
    assert c.find({"n": {"$gte": 0}}).count() == 25
    assert c.find({"n": {"$gte": 0}}, limit=0).count() == 25
    first = c.find({"n": {"$gte": 10}}, limit=5).collect()
    after = c.find({"n": {"$gte": 10}}, limit=5, bookmark=first[-1]["_id"]).collect()
    assert [r.n for r in first + after] == list(range(10, 20))
    assert [r.n for r in c.find({"n": {"$lt": 5}}, sort=[{"n": "desc"}], skip=1, limit=2).collect()] == [3, 2]


def test_clashing_names(spark):
    """Documents may have columns with the names of the engine's own."""
    c = Collection(spark.createDataFrame([("1", 5, "x", 7)], "_id string, value int, id string, k0 int"))
    assert rows(View([Emit(F.col("k0"), F.col("value"))]).query(c)) == [("1", 7, 5)]
    assert c.all_docs(include_docs=True).first().doc["id"] == "x"


def test_python_maps_skip_documents_they_fail_on(spark):
    from lakedoc.operators.views import PythonView

    c = Collection(spark.createDataFrame([("1", "a b"), ("2", None), ("3", "b")], "_id string, t string"))
    view = PythonView(function=lambda doc: ((w, 1) for w in doc["t"].split()), key="k0 string", value="int", columns=["t"], reduce="_sum")
    assert rows(view.query(c, group=True)) == [("a", 1), ("b", 2)]
    assert [r.id for r in view.query(c, reduce=False, key="b").collect()] == ["1", "3"]
