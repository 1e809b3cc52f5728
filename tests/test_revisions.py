"""Leaves, winners, batches of writes, feeds and replication."""

import pytest
from pyspark.sql import functions as F

from lakedoc.operators import revisions as R
from lakedoc.streaming.changes import Feed, by_selector, follow
from lakedoc.streaming.replicate import read_target, replicate, replicate_stream, replication_id

SCHEMA = "_id string, _rev string, _deleted boolean, _rev_history array<string>, v int"


def revs(spark, *rows):
    return spark.createDataFrame([(i, h[0], d, h, v) for i, h, d, v in rows], SCHEMA)


def ids(df):
    return sorted((r["_id"], r["_rev"]) for r in df.collect())


def test_winner_by_generation_then_hash_whatever_is_deleted(spark):
    leaves = revs(spark, ("a", ["9-z"], False, 1), ("a", ["10-a"], True, 2), ("b", ["1-a"], False, 3), ("b", ["1-b"], False, 4))
    assert ids(R.winners(leaves)) == [("a", "10-a"), ("b", "1-b")]
    got = {r["_id"]: r["conflicts"] for r in R.conflicts(leaves).collect()}
    assert got == {"a": ["9-z"], "b": ["1-a"]}
    assert {r["_id"]: r["conflicts"] for r in R.conflicts(leaves, deleted=True).collect()} == {"a": [], "b": []}


def test_ancestors_are_no_leaves(spark):
    table = revs(spark, ("a", ["1-x"], False, 1), ("a", ["2-y", "1-x"], False, 2), ("a", ["2-z", "1-x"], False, 3), ("a", ["2-z", "1-x"], False, 3))
    assert ids(R.leaves_of(table)) == [("a", "2-y"), ("a", "2-z")]


def test_revs_diff(spark):
    table = revs(spark, ("a", ["2-y", "1-x"], False, 1))
    asked = spark.createDataFrame([("a", "1-x"), ("a", "3-q"), ("b", "1-n")], "_id string, _rev string")
    got = {r["_id"]: (r["missing"], r["possible_ancestors"]) for r in R.revs_diff(asked, table).collect()}
    assert got == {"a": (["3-q"], ["2-y"]), "b": (["1-n"], [])}


def test_history_field_round_trip(spark):
    table = revs(spark, ("a", ["3-c", "2-b", "1-a"], False, 1))
    r = table.select(R.revisions_field().alias("r")).select("r", R.history_of(F.col("r.start"), F.col("r.ids")).alias("h")).first()
    assert (r.r.start, r.r.ids, r.h) == (3, ["c", "b", "a"], ["3-c", "2-b", "1-a"])


@pytest.fixture
def written(spark):
    current = revs(spark, ("a", ["1-a"], False, 1), ("b", ["2-b", "1-a"], False, 2), ("gone", ["2-g", "1-g"], True, 0))
    incoming = spark.createDataFrame(
        [("a", "1-a", False, 10, 0), ("b", "1-a", False, 20, 1), ("new", None, False, 30, 2), ("a", "1-a", False, 40, 3), ("gone", None, False, 50, 4), ("none", "1-x", True, 60, 5), ("b", None, False, 70, 6), ("bad", None, False, -1, 7)],
        "_id string, _rev string, _deleted boolean, v int, pos int",
    )
    return current, R.bulk_docs(current, incoming, R.first_failure([(F.col("v") >= 0, "negative")]).alias("x"))


def test_bulk_docs(written):
    _, out = written
    got = {r["pos"]: r["status"] for r in out.collect()}
    assert got == {0: "ok", 1: "conflict", 2: "ok", 3: "conflict", 4: "ok", 5: "not_found", 6: "conflict", 7: "forbidden"}
    rev = {r["pos"]: r["new_rev"] for r in out.collect()}
    assert rev[0].startswith("2-") and rev[2].startswith("1-") and rev[4].startswith("3-") and rev[1] is None


def test_apply_writes(written):
    current, out = written
    after = R.apply_writes(current, out)
    best = {r["_id"]: (r["v"], len(r["_rev_history"])) for r in R.winners(after).collect()}
    assert best == {"a": (10, 2), "b": (2, 2), "gone": (50, 3), "new": (30, 1)}


def test_compact_purge_copy(spark):
    table = revs(spark, ("a", ["3-c", "2-b", "1-a"], False, 1), ("b", ["1-a"], False, 2))
    assert [r["_rev_history"] for r in R.compact(table, 2).orderBy("_id").collect()] == [["3-c", "2-b"], ["1-a"]]
    assert ids(R.purge(table, spark.createDataFrame([("b", "1-a")], "_id string, _rev string"))) == [("a", "3-c")]
    copied = R.copy_document(table, "a", "c").first()
    assert (copied["_id"], copied["_rev"], copied["v"]) == ("c", None, 1)
    assert len(R.with_new_ids(table.drop("_id")).select("_id").distinct().collect()) == 2


def log(spark):
    rows = [(1, "a", "1-a", False, 1), (2, "b", "1-b", False, 2), (3, "a", "2-a", False, 3), (4, "c", "1-c", False, 4), (5, "b", "2-b", True, 0)]
    return spark.createDataFrame(rows, "_seq long, _id string, _rev string, _deleted boolean, v int")


def test_feed(spark):
    feed = Feed(log(spark))
    assert [(r.seq, r.id, r.deleted) for r in feed.changes().collect()] == [(3, "a", False), (4, "c", False), (5, "b", True)]
    assert [r.seq for r in feed.changes(since=3, limit=1).collect()] == [4]
    assert [r.seq for r in feed.changes(descending=True, limit=2).collect()] == [5, 4]
    assert tuple(feed.pending(since=0, limit=2).first()) == (4, 1)
    assert tuple(feed.pending(since=9).first()) == (9, 0)
    assert [r.id for r in Feed(log(spark), [by_selector({"v": {"$gt": 2}})]).changes().collect()] == ["a", "c"]


def test_follow_resumes_from_its_checkpoint(spark, tmp_path):
    source, got = tmp_path / "log", []
    log(spark).where("_seq <= 3").coalesce(1).write.parquet(str(source))
    stream = lambda: spark.readStream.schema(log(spark).schema).parquet(str(source))
    run = lambda: follow(stream(), lambda df, n: got.extend((r["_seq"], r["_id"]) for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    run()
    assert sorted(got) == [(2, "b"), (3, "a")]
    got.clear()
    log(spark).where("_seq > 3").coalesce(1).write.mode("append").parquet(str(source))
    run()
    assert sorted(got) == [(4, "c"), (5, "b")]


def test_running_latest_in_update_mode(spark, tmp_path):
    from lakedoc.streaming.changes import running_latest

    source = tmp_path / "log"
    log(spark).coalesce(1).write.parquet(str(source))
    q = running_latest(spark.readStream.schema(log(spark).schema).parquet(str(source))).writeStream.outputMode("update").format("memory").queryName("latest_rows").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["_seq"], r["_id"]) for r in spark.table("latest_rows").collect()) == [(3, "a"), (4, "c"), (5, "b")]


def test_replicate_merges_branches(spark):
    source = revs(spark, ("a", ["2-s", "1-x"], False, 1), ("b", ["1-b"], False, 2))
    target = revs(spark, ("a", ["2-t", "1-x"], False, 3), ("b", ["1-b"], False, 2), ("c", ["1-c"], False, 4))
    assert ids(replicate(source, target)) == [("a", "2-s"), ("a", "2-t"), ("b", "1-b"), ("c", "1-c")]
    assert ids(replicate(source, target, filters=[by_selector({"v": 2})])) == ids(target)
    assert replication_id("a", "b", x=1) == replication_id("a", "b", x=1) != replication_id("b", "a", x=1)


def test_replicate_stream_is_idempotent(spark, tmp_path):
    source, target = tmp_path / "s", str(tmp_path / "t")
    table = revs(spark, ("a", ["1-x"], False, 1), ("a", ["2-y", "1-x"], False, 2), ("b", ["1-b"], False, 3))
    table.coalesce(1).write.parquet(str(source))
    run = lambda cp: replicate_stream(spark.readStream.schema(table.schema).parquet(str(source)), target, str(tmp_path / cp)).awaitTermination()
    run("cp1")
    assert ids(read_target(spark, target, table.schema)) == [("a", "2-y"), ("b", "1-b")]
    run("cp2")  # a replay from the start sends nothing new
    assert ids(read_target(spark, target, table.schema)) == [("a", "2-y"), ("b", "1-b")]


def test_leaves_take_one_shuffle_and_explode_nothing(spark):
    table = revs(spark, ("a", ["1-x"], False, 1), ("a", ["2-y", "1-x"], False, 2), ("b", ["3-c", "2-b", "1-a"], False, 3), ("b", ["2-b", "1-a"], False, 3), ("b", ["2-z", "1-a"], False, 4), ("b", ["3-q", "2-z"], True, 5))
    leaves = R.leaves_of(table)
    assert ids(leaves) == [("a", "2-y"), ("b", "3-c"), ("b", "3-q")]
    plan = R.leaves_of(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan and "Join" not in plan


def test_deleting_a_losing_leaf_keeps_the_other(spark):
    leaves = revs(spark, ("a", ["2-x", "1-a"], False, 1), ("a", ["2-y", "1-a"], False, 2))
    gone = spark.createDataFrame([("a", "2-y"), ("a", "9-n"), ("none", "1-a")], "_id string, _rev string")
    results = R.delete_leaves(leaves, gone)
    assert sorted((r["_rev"], r["status"]) for r in results.collect()) == [("1-a", "conflict"), ("2-y", "ok"), ("9-n", "conflict")]
    done = R.apply_writes(leaves, results)
    assert sorted((r["_rev"].split("-")[0], r["_deleted"]) for r in done.collect()) == [("2", False), ("3", True)]
    assert [r["status"] for r in R.delete_leaves(done.where("_deleted"), done.where("_deleted")).collect()] == ["conflict"]


def test_id_conditions_reach_the_scan(spark, sf):
    from lakedoc.operators.collection import Collection
    from lakedoc.plans.queries import _mixed, of

    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = lambda df: df._jdf.queryExecution().toString()
        orders = of(spark, sf, "orders")
        assert "EqualTo(o_orderkey,7)" in plan(orders.get("orders:7"))
        some = orders.all_docs(startkey="orders:10", endkey="orders:2")
        assert "PushedFilters: [Or(" in plan(some)
        every = sorted(f"orders:{r[0]}" for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").collect())
        for low, high in (("orders:10", "orders:2"), ("orders:", None), (None, "orders:5"), ("orders:3x", "orders:4:"), ("a", "z"), ("orders:99", "orders:1")):
            got = sorted(r["id"] for r in orders.all_docs(startkey=low, endkey=high).collect())
            assert got == [i for i in every if (low is None or i >= low) and (high is None or i <= high)], (low, high)
        part = plan(_mixed(spark, sf).partition("nation").docs)
        assert "nation" in part and "supplier.parquet" not in part
        odd = Collection.from_table(spark.createDataFrame([(-5,), (0,), (12,), (None,), (10**17,)], "k long"), "p", ["k"])
        assert [r["k"] for r in odd.get("p:-5").collect()] == [-5] and odd.get("p:05").count() == 0 and odd.get("q:12").count() == 0
        assert sorted(r["id"] for r in odd.all_docs(startkey="p:-", endkey="p:1").collect()) == ["p:-5", "p:0"]
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
