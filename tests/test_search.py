"""Search, facets and groups on five people, and sources and sinks."""

import pytest
from pyspark.sql import functions as F

from lakedoc.functions.text import analyse, highlight, whitespace_tokens, wildcard_pattern
from lakedoc.operators.collection import Collection
from lakedoc.operators.registry import IndexRegistry, update, write_indexed
from lakedoc.operators.search import Everything, IndexField, NumberRange, Phrase, SearchIndex, Term, Wildcard
from lakedoc.sources.documents import attachment_references, read_attachments, read_json_lines, read_partition, write_json_lines, write_partitioned


@pytest.fixture
def people(spark):
    data = [("doc1", "alice", "person", 30, "Alice likes green tea"), ("doc2", "bob", "person", 25, "Bob drinks tea, green leaves too"), ("doc3", "carol", "person", 35, "coffee"), ("doc4", "dave", "admin", 40, None), ("doc5", "eve", "person", 28, "the of and")]
    c = Collection(spark.createDataFrame(data, "_id string, name string, type string, age int, bio string"))
    return SearchIndex(c, {"name": IndexField(F.col("name"), store=True), "type": IndexField(F.col("type"), store=True, facet=True), "bio": IndexField(F.col("bio")), "age": IndexField(F.col("age"), kind="number", store=True)})


@pytest.mark.parametrize(
    ("query", "want"),
    [
        (Everything(), "12345"),
        (Term("alice"), "1"),
        (Term("ALICE", "name"), "1"),
        (Term("alice bob", "name"), "12"),
        (Term("person", "name"), ""),
        (Term("the"), ""),
        (Phrase("green tea", "bio"), "1"),
        (Phrase("tea green"), "2"),
        (Wildcard("?o*", "name"), "2"),
        (Wildcard("*a*", "name"), "134"),
        (Term("person", "type") & ~Term("bob"), "135"),
        (~Term("person", "type"), "4"),
        (~Term("tea", "bio"), "345"),
        (Term("carol") | Term("admin") & Term("dave"), "34"),
        (NumberRange("age", 28, 35), "15"),
        (NumberRange("age", None, 28), "2"),
    ],
)
def test_queries(people, query, want):
    assert "".join(sorted(r["_id"][-1] for r in people.hits(query).collect())) == want


def test_pages_facets_and_groups(people):
    page = people.search(Term("person", "type"), sort=["-age"], limit=2)
    assert [(r["_id"], r["age"]) for r in page.collect()] == [("doc3", 35), ("doc1", 30)]
    assert [r["_id"] for r in people.search(Term("person", "type"), sort=["-age"], limit=2, bookmark=2).collect()] == ["doc5", "doc2"]
    assert people.search(Everything(), include_fields=["name"]).columns == ["_id", "name"]
    assert sorted(tuple(r) for r in people.counts(Everything(), ["type"]).collect()) == [("type", "admin", 1), ("type", "person", 4)]
    assert sorted(tuple(r) for r in people.ranges(Everything(), {"age": {"young": (0, 30), "old": (30, None)}}).collect()) == [("age", "old", 3), ("age", "young", 2)]
    assert people.total(Everything(), [("type", ["admin"])]).first()[0] == 1
    got = {(r.group, r.place): (r.total_rows, r["_id"]) for r in people.groups(Everything(), "type", group_limit=2, sort=["age"]).collect()}
    assert got == {("admin", 1): (1, "doc4"), ("person", 1): (4, "doc2"), ("person", 2): (4, "doc5")}


def test_rank_and_highlight(people):
    got = people.search(Term("green tea", "bio"), highlight_fields=["bio"]).collect()
    assert [r["_id"] for r in got] == ["doc1", "doc2"]
    assert "<em>green</em> <em>tea</em>" in got[0]["highlight_bio"]


def test_highlights_mark_what_analysis_finds(spark):
    rows = [(0, "\U0001f375" * 300 + " green_tea, Tea " + "x" * 300), (1, "steam and teas"), (2, None), (3, "")]
    got = {r["id"]: r["h"] for r in spark.createDataFrame(rows, "id int, t string").select("id", highlight(F.col("t"), ["tea"]).alias("h")).collect()}
    assert "green_<em>tea</em>, <em>Tea</em> x" in got[0] and got[1] is got[2] is got[3] is None


def test_a_phrase_stands_in_one_field(people):
    both = people.hits(Phrase("alice person"))
    assert both.count() == 0 and people.hits(Phrase("likes green")).count() == 1



def test_postings(people):
    got = {(r.term, r.id, r.pos) for r in people.postings().where("field = 'bio'").collect()}
    assert ("tea", "doc1", 3) in got and not [x for x in got if x[0] == "the"]


def test_stored_postings_find_what_a_scan_finds(people, tmp_path):
    stored = people.write_postings(f"file://{tmp_path}/p")
    queries = [Term("tea"), Term("tea", "bio"), Term("the"), Phrase("green tea", "bio"), Phrase("tea green"), Wildcard("t*a", "bio"), Term("tea") & ~Term("green"), ~Term("tea"), Term("nothing here") | Phrase("", "bio")]
    for q in queries:
        assert sorted(r[0] for r in stored.hits(q).select(people.id_col).collect()) == sorted(r[0] for r in people.hits(q).select(people.id_col).collect()), q
    plan = stored.hits(Term("tea", "bio"))._jdf.queryExecution().toString()
    assert "EqualTo(field,bio)" in plan and "EqualTo(term,tea)" in plan


def test_analysis(spark):
    assert analyse("The quick, QUICK fox_1") == ["quick", "quick", "fox", "1"]
    assert wildcard_pattern("a.*?") == r"^a\..*.$"
    one = spark.createDataFrame([(" A b\tc\n",), (None,)], "t string").select(whitespace_tokens(F.col("t")).alias("x")).collect()
    assert one[0].x == ["A", "b", "c"] and one[1].x is None


def test_json_lines_round_trip(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"_id":"a","n":1}\n{"_id":"b","x":{"y":[1,"z"]}}\nnot json\n')
    c = read_json_lines(spark, str(tmp_path / "in.json"))
    assert [r["_id"] for r in c.find({"x.y": {"$size": 2}}).collect()] == ["b"]
    write_json_lines(c, str(tmp_path / "out"))
    again = read_json_lines(spark, str(tmp_path / "out"))
    assert [r["_id"] for r in again.find({"n": 1}).collect()] == ["a"]


def test_partitions_prune(spark, tmp_path):
    c = Collection(spark.createDataFrame([("p:1", 1), ("p:2", 2), ("q:1", 3)], "_id string, v int"))
    write_partitioned(c, str(tmp_path / "t"))
    p = read_partition(spark, str(tmp_path / "t"), "p")
    assert p.find({"v": {"$gt": 0}}).count() == 2
    assert "PartitionFilters: [isnotnull(_partition" in p.docs._jdf.queryExecution().toString()


def test_attachments(spark, tmp_path):
    for n, b in (("a.bin", b"x"), ("b.bin", b"x"), ("c.bin", b"yy")):
        (tmp_path / n).write_bytes(b)
    got = sorted(r.refs for r in attachment_references(read_attachments(spark, str(tmp_path))).collect())
    assert got == [1, 2]


def test_registry_update_and_layout(spark, tmp_path):
    r = IndexRegistry()
    assert (r.create(["a"]), r.create(["a"])) == ("created", "exists")
    assert r.frame(spark).first()["name"] == "_all_docs"
    df = spark.range(100).select(F.col("id").cast("string").alias("_id"), "id")
    write_indexed(df, str(tmp_path / "x"), ["id"], files=4)
    assert spark.read.parquet(str(tmp_path / "x")).count() == 100
    assert update(df, lambda d: d.withColumn("v", F.lit(1))).columns == ["_id", "id", "v"]
    with pytest.raises(ValueError):
        update(df, lambda d: d.drop("_id"))


def test_collection_ids(spark):
    c = Collection(spark.createDataFrame([("a",), ("b",), ("c",), ("_design/d",)], "_id string"))
    assert [r.id for r in c.all_docs(startkey="a", endkey="c", inclusive_end=False, limit=9).collect()] == ["a", "b"]
    assert [r.id for r in c.all_docs(startkey="c", endkey="b", descending=True, limit=9).collect()] == ["c", "b"]
    assert tuple(c.info().first()) == (4, 0, None)
    assert c.find({"_id": {"$gt": ""}}).count() == 3
