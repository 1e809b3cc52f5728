"""The registered queries over the test tables, each beside the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import revisions as R
from ..operators.collection import Collection
from ..operators.registry import IndexRegistry, database_updates, databases, layout_sizes, lookup, update, write_indexed
from ..operators.search import Everything, IndexField, NumberRange, Phrase, SearchIndex, Term, Wildcard
from ..operators.views import Emit, GroupedReduce, PythonView, View, all_levels
from ..sources.documents import as_attachments, attachment_references
from ..streaming.changes import Feed, by_condition, by_id_table, by_ids, by_selector, design_only, follow, new_folder
from ..streaming.materialise import maintain, maintained
from ..streaming.replicate import common_checkpoint, replicate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


KEYS = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "part": ["p_partkey"], "lineitem": ["l_orderkey", "l_linenumber"], "documents": ["doc_id"], "events": ["event_id"], "supplier": ["s_suppkey"], "nation": ["n_nationkey"]}


def of(spark: SparkSession, d: str, name: str) -> Collection:
    return Collection.from_table(table(spark, d, name), name, KEYS[name])


def events_json(spark: SparkSession, d: str) -> Collection:
    """Events whose ``props`` text is a JSON document of any shape."""
    e = table(spark, d, "events")
    return Collection(e.select(F.col("event_id").cast("string").alias("_id"), "event_id", "user_id", F.try_parse_json("props").alias("props")), order=("event_id",))


# -- find ------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def find_eq_gt(spark, d):
    return of(spark, d, "orders").find({"o_orderstatus": "F", "o_totalprice": {"$gt": 100000}}, fields=["o_orderkey", "o_totalprice"], sort=[{"o_totalprice": "desc"}], limit=10).drop("_id")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal < 0")
def find_or(spark, d):
    return of(spark, d, "customer").find({"$or": [{"c_mktsegment": "BUILDING"}, {"c_acctbal": {"$lt": 0}}]}, limit=None).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT (c_mktsegment = 'BUILDING' OR c_nationkey >= 12)")
def find_nor(spark, d):
    return of(spark, d, "customer").find({"$nor": [{"c_mktsegment": "BUILDING"}, {"c_nationkey": {"$gte": 12}}]}, limit=None).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT (c_acctbal <= 5000)")
def find_not(spark, d):
    return of(spark, d, "customer").find({"$not": [{"c_acctbal": {"$lte": 5000}}]}, limit=None).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE (o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH') AND o_orderstatus = 'O' AND o_totalprice >= 150000 AND o_totalprice < 300000")
def find_and_nested(spark, d):
    selector = {"$and": [{"$or": [{"o_orderpriority": "1-URGENT"}, {"o_orderpriority": "2-HIGH"}]}, {"o_orderstatus": {"$eq": "O"}}], "o_totalprice": {"$gte": 150000, "$lt": 300000}}
    return of(spark, d, "orders").find(selector, limit=None).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9, 14)")
def find_in(spark, d):
    return of(spark, d, "part").find({"p_size": {"$in": [1, 5, 9, 14]}}, limit=None).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size NOT IN (1, 5, 9, 14)")
def find_nin(spark, d):
    return of(spark, d, "part").find({"p_size": {"$nin": [1, 5, 9, 14, "x"]}}, limit=None).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size % 7 = 3")
def find_mod(spark, d):
    return of(spark, d, "part").find({"p_size": {"$mod": [7, 3]}}, limit=None).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^[a-m].*e')")
def find_regex(spark, d):
    return of(spark, d, "part").find({"p_name": {"$regex": "^[a-m].*e"}}, limit=None).select("p_partkey")


@query("SELECT event_id FROM events WHERE json_extract(props, '$.k') IS NULL OR CAST(props->>'$.k' AS DOUBLE) <> 7")
def find_ne_missing(spark, d):
    return events_json(spark, d).find({"props.k": {"$ne": 7}}, limit=None).select("event_id")


def _uneven(spark, d) -> Collection:
    """Events of several shapes: ``k`` is missing, null, a string, or a number, and some have a list."""
    n = F.col("event_id") % 5
    text = F.when(n == 0, "{}").when(n == 1, '{"k": null}').when(n == 2, '{"k": "x"}').when(n == 3, '{"k": 4, "list": [1]}').otherwise(F.col("props"))
    return Collection(table(spark, d, "events").select(F.col("event_id").cast("string").alias("_id"), "event_id", F.try_parse_json(text).alias("props")), order=("event_id",))


@query("SELECT event_id FROM events WHERE event_id % 5 IN (2, 4)")
def find_exists(spark, d):
    """A field that is null or missing does not exist."""
    return _uneven(spark, d).find({"props.k": {"$exists": True}, "props.list": {"$exists": False}}, limit=None).select("event_id")


@query("SELECT event_id FROM events WHERE event_id % 5 = 3 OR (event_id % 5 = 4 AND json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE'))")
def find_type(spark, d):
    return _uneven(spark, d).find({"props.k": {"$type": "number"}}, limit=None).select("event_id")


@query("SELECT event_id FROM events WHERE CAST(props->>'$.k' AS INT) >= 50")
def find_variant_path(spark, d):
    return events_json(spark, d).find({"props.k": {"$gte": 50}}, limit=None).select("event_id")


@query("SELECT event_id FROM events WHERE CAST(props->>'$.k' AS INT) % 10 = 4")
def find_variant_mod(spark, d):
    return events_json(spark, d).find({"props": {"k": {"$mod": [10, 4]}}}, limit=None).select("event_id")


@query("SELECT p_partkey FROM part WHERE list_has_all(string_split(p_name, ' '), [string_split(p_name, ' ')[1]]) AND len(string_split(p_name, ' ')) = 2")
def find_size(spark, d):
    c = Collection.from_table(table(spark, d, "part").withColumn("tags", F.split("p_name", " ")), "part", ["p_partkey"])
    return c.find({"tags": {"$size": 2}}, limit=None).select("p_partkey")


@query("SELECT doc_id FROM documents WHERE list_has_all(string_split(text, ' '), ['the', 'of'])")
def find_all(spark, d):
    c = Collection.from_table(table(spark, d, "documents").withColumn("tags", F.split("text", " ")), "documents", ["doc_id"])
    return c.find({"tags": {"$all": ["the", "of"]}}, limit=None).select("doc_id")


@query("SELECT doc_id FROM documents WHERE len(list_filter(string_split(text, ' '), lambda x: x >= 'z' )) > 0")
def find_elem_match(spark, d):
    c = Collection.from_table(table(spark, d, "documents").withColumn("tags", F.split("text", " ")), "documents", ["doc_id"])
    return c.find({"tags": {"$elemMatch": {"$gte": "z"}}}, limit=None).select("doc_id")


@query("SELECT doc_id FROM documents WHERE len(list_filter(string_split(lang, ' '), lambda x: x < 'e')) = len(string_split(lang, ' '))")
def find_all_match(spark, d):
    c = Collection.from_table(table(spark, d, "documents").withColumn("tags", F.split("lang", " ")), "documents", ["doc_id"])
    return c.find({"tags": {"$allMatch": {"$lt": "e"}}}, limit=None).select("doc_id")


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_acctbal > 0 ORDER BY c_nationkey, c_acctbal DESC, c_custkey LIMIT 20 OFFSET 10")
def find_sort_page(spark, d):
    return of(spark, d, "customer").find({"c_acctbal": {"$gt": 0}}, fields=["c_custkey", "c_nationkey", "c_acctbal"], sort=["c_nationkey", {"c_acctbal": "desc"}], skip=10, limit=20).drop("_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey > 1000 ORDER BY o_orderkey LIMIT 25")
def find_bookmark(spark, d):
    return of(spark, d, "orders").find({"o_orderstatus": "F"}, bookmark=[1000]).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-04-01'")
def find_date_range(spark, d):
    return of(spark, d, "orders").find({"o_orderdate": {"$gte": "1995-01-01", "$lt": "1995-04-01"}}, limit=None).select("o_orderkey")


@query("SELECT event_id FROM events WHERE event_id % 5 = 2")
def find_type_strict(spark, d):
    """Texts above "4" alone: neither the number 4 and those above it nor missing fields compare with a text."""
    return _uneven(spark, d).find({"props.k": {"$gt": "4"}}, limit=None).select("event_id")


@query("SELECT 0::BIGINT AS of_none, count(*) AS of_all FROM orders")
def find_empty_selector(spark, d):
    """The empty selector finds nothing; a bound that every document meets finds all."""
    c = of(spark, d, "orders")
    found = c.find({}, limit=None).select(F.lit("of_none").alias("of")).unionByName(c.find({"o_orderkey": {"$gte": 0}}, limit=None).select(F.lit("of_all").alias("of")))
    return found.agg(F.count_if(F.col("of") == "of_none").alias("of_none"), F.count_if(F.col("of") == "of_all").alias("of_all"))


@query("SELECT c_custkey, c_name AS name, c_acctbal AS bal FROM customer WHERE c_nationkey = 3")
def find_project_nested(spark, d):
    c = Collection.from_table(table(spark, d, "customer").withColumn("info", F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_acctbal").alias("bal")).alias("acct"))), "customer", ["c_custkey"])
    return c.find({"c_nationkey": 3}, fields=["c_custkey", "info.name", "info.acct.bal"], limit=None).select("c_custkey", "info.name", "info.acct.bal")


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 5")
def find_nested_shorthand(spark, d):
    c = Collection.from_table(table(spark, d, "customer").withColumn("info", F.struct(F.col("c_nationkey").alias("nation"))), "customer", ["c_custkey"])
    return c.find({"info": {"nation": {"$eq": 5}}}, limit=None).select("c_custkey")


@query("SELECT event_id FROM events WHERE event_type >= 'p'")
def find_key_map_match(spark, d):
    c = Collection.from_table(table(spark, d, "events").withColumn("by_type", F.create_map("event_type", "value")), "events", ["event_id"])
    return c.find({"by_type": {"$keyMapMatch": {"$gte": "p"}}}, limit=None).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_custkey <= 40 AND o_orderstatus <> 'F' AND o_totalprice <= 250000")
def find_ne_lte(spark, d):
    return of(spark, d, "orders").find({"o_custkey": {"$lte": 40}, "o_orderstatus": {"$ne": "F"}, "o_totalprice": {"$lte": 250000}}, limit=None).select("o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'MACHINERY' ORDER BY c_custkey LIMIT 25")
def find_default_limit(spark, d):
    return of(spark, d, "customer").find({"c_mktsegment": "MACHINERY"}, fields=["c_custkey", "c_name"], limit=0).drop("_id")


@query("SELECT true AS pushed, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 5")
def find_explain(spark, d):
    """Whether the plan that ``explain`` shows takes both conditions to the Parquet scan, beside what the query finds."""
    c = of(spark, d, "orders")
    selector = {"o_orderstatus": "F", "o_totalprice": {"$gt": 5}}
    plan = c.explain(selector, limit=None)["plan"]
    pushed = "EqualTo(o_orderstatus,F)" in plan and "GreaterThan(o_total" in plan
    return c.find(selector, limit=None).agg(F.count(F.lit(1)).alias("n")).select(F.lit(pushed).alias("pushed"), "n")


@query("SELECT name, type, n FROM (SELECT '_all_docs' AS name, 'special' AS type, count(*) AS n FROM orders UNION ALL SELECT 'by-o_custkey', 'json', count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'by_status', 'json', count(DISTINCT o_orderstatus) FROM orders)")
def index_registry(spark, d):
    """The registered indexes, each with how many keys it tells apart in the orders."""
    r = IndexRegistry()
    r.create(["o_orderstatus"], name="by_status")
    r.create(["o_orderstatus"], name="by_status")
    r.create(["o_custkey"])
    r.create(["o_totalprice"], name="gone", ddoc="_design/x")
    r.delete("_design/x", "gone")
    docs = of(spark, d, "orders").docs
    keys = F.explode(F.array(*[F.struct(F.lit(i["name"]).alias("name"), F.concat_ws(":", *[F.col(c).cast("string") for c in i["fields"]]).alias("key")) for i in [{"name": "_all_docs", "fields": ["_id"]}, *r.indexes]]))
    found = docs.select(keys.alias("e")).select("e.*").groupBy("name").agg(F.countDistinct("key").alias("n"))
    return r.frame(spark).join(found, "name").select("name", "type", "n")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7")
def index_lookup(spark, d):
    """Equality on a layout sorted by the field."""
    path = new_folder(spark, "by-custkey")
    write_indexed(table(spark, d, "orders"), path, ["o_custkey"])
    return lookup(spark, path, {"o_custkey": 7}).select("o_orderkey", "o_totalprice")


@query("SELECT count(*) AS rows, true AS sized FROM orders")
def index_sizes(spark, d):
    """Rows of a layout, and whether its files have a size."""
    path = new_folder(spark, "by-custkey")
    write_indexed(table(spark, d, "orders"), path, ["o_custkey"])
    return layout_sizes(spark, path).select("rows", ((F.col("bytes") > 0) & (F.col("files") > 0)).alias("sized"))


# -- ids -----------------------------------------------------------------------------------


@query("SELECT 'nation:' || n_nationkey AS id, n_name AS name FROM nation WHERE 'nation:' || n_nationkey BETWEEN 'nation:10' AND 'nation:2' AND 'nation:' || n_nationkey < 'nation:2'")
def all_docs_range(spark, d):
    return of(spark, d, "nation").all_docs(startkey="nation:10", endkey="nation:2", inclusive_end=False, include_docs=True).select("id", F.col("doc.n_name").alias("name"))


@query("SELECT 'customer:' || c_custkey AS id FROM customer ORDER BY 1 DESC LIMIT 7 OFFSET 3")
def all_docs_descending(spark, d):
    return of(spark, d, "customer").all_docs(descending=True, skip=3, limit=7).select("id")


_REQUESTED = ["nation:3", "nation:99", "nation:0", "nation:3"]


@query("SELECT pos, k AS key, 'nation:' || n_nationkey AS id, CASE WHEN n_nationkey IS NULL THEN 'not_found' END AS error FROM (VALUES (0, 'nation:3'), (1, 'nation:99'), (2, 'nation:0'), (3, 'nation:3')) v(pos, k) LEFT JOIN nation ON k = 'nation:' || n_nationkey")
def all_docs_keys(spark, d):
    keys = spark.createDataFrame(list(enumerate(_REQUESTED)), "pos int, key string")
    return of(spark, d, "nation").all_docs_by_keys(keys).select("pos", "key", "id", "error")


@query("SELECT k AS id, n_name AS name, CASE WHEN n_nationkey IS NULL THEN 'not_found' END AS error FROM (VALUES ('nation:3'), ('nation:99'), ('nation:0')) v(k) LEFT JOIN nation ON k = 'nation:' || n_nationkey")
def bulk_get(spark, d):
    ids = spark.createDataFrame([(k,) for k in _REQUESTED[:3]], "id string")
    return of(spark, d, "nation").bulk_get(ids).select("id", F.col("ok.n_name").alias("name"), "error")


@query("SELECT n_name FROM nation WHERE n_nationkey = 7")
def get_document(spark, d):
    return of(spark, d, "nation").get("nation:7").select("n_name")


def _mixed(spark, d) -> Collection:
    """Nations and suppliers in one collection: two partitions by id prefix."""
    n, s = of(spark, d, "nation"), of(spark, d, "supplier")
    n.docs = n.docs.select("_id", F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("number"))
    s.docs = s.docs.select("_id", F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("number"))
    return Collection.of_parts([n, s])


@query("SELECT 'supplier:' || s_suppkey AS id FROM supplier WHERE 'supplier:' || s_suppkey >= 'supplier:5' ORDER BY 1 LIMIT 12")
def partition_all_docs(spark, d):
    return _mixed(spark, d).partition("supplier").all_docs(startkey="supplier:5", limit=12).select("id")


@query("SELECT n_name AS name FROM nation WHERE n_regionkey >= 2")
def partition_find(spark, d):
    return _mixed(spark, d).find({"number": {"$gte": 2}}, partition="nation", limit=None).select("name")


@query("SELECT '_all_docs' AS name, true AS own, false AS other, count(*) AS n FROM nation WHERE n_regionkey >= 2")
def partition_explain(spark, d):
    """The index that a search within a partition reports, and which tables its plan reads."""
    c, selector = _mixed(spark, d), {"number": {"$gte": 2}}
    told = c.explain(selector, partition="nation", limit=None)
    reads = {t: f"{t}.parquet" in told["plan"] for t in ("nation", "supplier")}
    return c.find(selector, partition="nation", limit=None).agg(F.lit(told["index"]["name"]).alias("name"), F.lit(reads["nation"]).alias("own"), F.lit(reads["supplier"]).alias("other"), F.count(F.lit(1)).alias("n"))


@query("SELECT 'supplier' AS partition, count(*) AS doc_count, 0::BIGINT AS doc_del_count FROM supplier")
def partition_info(spark, d):
    return _mixed(spark, d).partition_info("supplier")


@query("SELECT (SELECT count(DISTINCT user_id) FROM events) - count(*) AS doc_count, count(*) AS doc_del_count, (SELECT max(event_id) FROM events) AS update_seq FROM (SELECT user_id, arg_max(event_type, event_id) AS t FROM events GROUP BY user_id) WHERE t = 'purchase'")
def collection_info(spark, d):
    return Collection(Feed(_log(spark, d)).events(), order=("_id",)).info()


@query("SELECT DISTINCT event_type AS name FROM events WHERE event_type BETWEEN 'c' AND 'q'")
def list_databases(spark, d):
    """Names in a range; each kind of event is a collection of its own."""
    return databases(table(spark, d, "events").select(F.col("event_type").alias("name")).distinct(), startkey="c", endkey="q")


@query("SELECT event_type AS db_name, 'updated' AS type, max(event_id) AS seq FROM events GROUP BY event_type")
def list_database_updates(spark, d):
    e = table(spark, d, "events")
    return database_updates(e.select(F.col("event_type").alias("db_name"), F.col("event_id").alias("_seq")))


def _special(spark, d) -> Collection:
    """Nations as documents of three kinds, by their region."""
    n = table(spark, d, "nation")
    head = F.when(F.col("n_regionkey") == 0, "_design/").when(F.col("n_regionkey") == 1, "_local/").otherwise("")
    return Collection(n.select(F.concat(head, "n_name").alias("_id"), F.concat(F.lit("0-"), (F.col("n_nationkey") + 1).cast("string")).alias("_rev"), "n_nationkey"))


@query("SELECT '_design/' || n_name AS id FROM nation WHERE n_regionkey = 0")
def design_documents(spark, d):
    return _special(spark, d).design_docs().select("id")


@query("SELECT '_local/' || n_name AS id FROM nation WHERE n_regionkey = 1 ORDER BY 1 DESC LIMIT 3")
def local_documents(spark, d):
    return _special(spark, d).local_docs(descending=True, limit=3).select("id")


@query("SELECT '_local/' || n_name AS _id, CASE WHEN n_nationkey % 2 = 0 THEN 'ok' ELSE 'conflict' END AS status, CASE WHEN n_nationkey % 2 = 0 THEN '0-' || (n_nationkey + 2) END AS new_rev FROM nation WHERE n_regionkey = 1 UNION ALL SELECT '_local/new', 'ok', '0-1'")
def local_documents_put(spark, d):
    """Local documents have no history: their revisions count up. Every second write names a stale one."""
    held = _special(spark, d).docs.where(F.col("_id").startswith("_local/"))
    incoming = held.select("_id", F.when(F.col("n_nationkey") % 2 == 0, F.col("_rev")).otherwise("0-0").alias("_rev")).unionByName(spark.createDataFrame([("_local/new", None)], "_id string, _rev string"))
    return R.put_local(held, incoming).select("_id", "status", "new_rev")


@query("WITH l AS (SELECT user_id::VARCHAR AS id, arg_max(event_type, event_id) AS t FROM events GROUP BY user_id), k AS (SELECT DISTINCT o_custkey::VARCHAR AS key FROM orders) SELECT key, id, t = 'purchase' AS deleted, CASE WHEN id IS NULL THEN 'not_found' END AS error FROM k LEFT JOIN l ON key = id")
def all_docs_keys_deleted(spark, d):
    """Requested keys of deleted documents say so; only unknown ones are not found."""
    keys = table(spark, d, "orders").select(F.lit(0).alias("pos"), F.col("o_custkey").cast("string").alias("key")).distinct()
    return Collection(Feed(_log(spark, d)).events()).all_docs_by_keys(keys).select("key", "id", "deleted", "error")


# -- views ---------------------------------------------------------------------------------


def _flags(value=None, reduce=None) -> View:
    return View([Emit([F.col("l_returnflag"), F.col("l_linestatus"), F.year("l_shipdate")], value)], reduce)


@query("SELECT 1 AS part, 'nation:' || n_nationkey AS id FROM nation WHERE n_nationkey = 4 UNION ALL SELECT 2, id FROM (SELECT 'nation:' || n_nationkey AS id FROM nation ORDER BY 1 DESC LIMIT 3)")
def all_docs_queries(spark, d):
    a, b = of(spark, d, "nation").queries([{"key": "nation:4"}, {"descending": True, "limit": 3}])
    return a.select(F.lit(1).alias("part"), "id").unionByName(b.select(F.lit(2).alias("part"), "id"))


@query("SELECT 'md5-' || to_base64(unhex(md5(n_comment))) AS digest, octet_length(encode(n_comment))::BIGINT AS length, count(*) AS refs FROM (SELECT c_mktsegment AS n_comment FROM customer) GROUP BY ALL")
def attachments_by_digest(spark, d):
    """Each content once, with how many documents attach it."""
    rows = of(spark, d, "customer").docs.select("_id", F.lit("segment.txt").alias("name"), F.encode("c_mktsegment", "UTF-8").alias("content"))
    return attachment_references(as_attachments(rows))


@query("SELECT count(*) AS value FROM lineitem")
def view_count_global(spark, d):
    return _flags(reduce="_count").query(of(spark, d, "lineitem"))


@query("SELECT l_returnflag AS k0, l_linestatus AS k1, year(l_shipdate)::INT AS k2, count(*) AS value FROM lineitem GROUP BY ALL")
def view_count_group(spark, d):
    return _flags(reduce="_count").query(of(spark, d, "lineitem"), group=True)


@query("SELECT l_returnflag AS k0, sum(l_quantity) AS value FROM lineitem GROUP BY ALL")
def view_sum_group_level1(spark, d):
    return _flags(F.col("l_quantity"), "_sum").query(of(spark, d, "lineitem"), group_level=1)


@query("SELECT l_returnflag AS k0, l_linestatus AS k1, sum(l_quantity) AS value FROM lineitem GROUP BY ALL")
def view_sum_group_level2(spark, d):
    return _flags(F.col("l_quantity"), "_sum").query(of(spark, d, "lineitem"), group_level=2)


@query("SELECT p_brand AS k0, sum(p_size)::BIGINT AS value FROM part GROUP BY ALL")
def view_sum_integers(spark, d):
    return View([Emit(F.col("p_brand"), F.col("p_size"))], "_sum").query(of(spark, d, "part"), group=True)


@query("SELECT c_mktsegment AS k0, round(sum(c_acctbal), 2) AS sum, min(c_acctbal) AS min, max(c_acctbal) AS max, count(*) AS count, round(sum(c_acctbal * c_acctbal) / 1e6, 2) AS sumsqr FROM customer GROUP BY ALL")
def view_stats_group(spark, d):
    out = View([Emit(F.col("c_mktsegment"), F.col("c_acctbal"))], "_stats").query(of(spark, d, "customer"), group=True)
    return out.withColumn("sum", F.round("sum", 2)).withColumn("sumsqr", F.round(F.col("sumsqr") / 1e6, 2))


@query("SELECT l_returnflag AS k0, sum(l_quantity) AS quantity, sum(l_linenumber)::DOUBLE AS lines FROM lineitem GROUP BY ALL")
def view_sum_array(spark, d):
    view = View([Emit(F.col("l_returnflag"), F.array(F.col("l_quantity"), F.col("l_linenumber").cast("double")))], "_sum")
    return view.query(of(spark, d, "lineitem"), group=True).select("k0", F.col("value")[0].alias("quantity"), F.col("value")[1].alias("lines"))


@query("SELECT w AS k0, count(*) AS value FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY ALL")
def view_multi_emit(spark, d):
    view = View([Emit(lambda w: w, each=F.split("p_name", " "))], "_count")
    return view.query(of(spark, d, "part"), group=True, limit=None)


@query("SELECT 'part:' || p_partkey AS id, p_brand AS k0, p_size AS value FROM part WHERE p_size > 25 UNION ALL SELECT 'part:' || p_partkey, p_type, p_size FROM part")
def view_conditional_emits(spark, d):
    view = View([Emit(F.col("p_brand"), F.col("p_size"), when=F.col("p_size") > 25), Emit(F.col("p_type"), F.col("p_size"))])
    return view.query(of(spark, d, "part"), limit=None)


@query("SELECT 'orders:' || o_orderkey AS id, o_totalprice AS k0 FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 120000")
def view_range_excl(spark, d):
    return View([Emit(F.col("o_totalprice"))]).query(of(spark, d, "orders"), startkey=100000, endkey=120000, inclusive_end=False, limit=None).select("id", "k0")


@query("SELECT 'lineitem:' || l_orderkey || ':' || l_linenumber AS id, l_returnflag AS k0, l_linestatus AS k1, year(l_shipdate)::INT AS k2 FROM lineitem WHERE (l_returnflag, l_linestatus) >= ('N', 'O') AND (l_returnflag < 'R' OR (l_returnflag = 'R' AND l_linestatus < 'F'))")
def view_array_range(spark, d):
    return _flags().query(of(spark, d, "lineitem"), startkey=["N", "O"], endkey=["R", "F"], limit=None).select("id", "k0", "k1", "k2")


@query("SELECT 'orders:' || o_orderkey AS id, o_totalprice AS k0 FROM orders WHERE o_totalprice <= 300000 ORDER BY o_totalprice DESC, id DESC LIMIT 15")
def view_descending(spark, d):
    return View([Emit(F.col("o_totalprice"))]).query(of(spark, d, "orders"), startkey=300000, descending=True, limit=15).select("id", "k0")


@query("SELECT 'nation:' || n_nationkey AS id, n_regionkey AS k0 FROM nation WHERE n_regionkey IN (1, 3)")
def view_keys(spark, d):
    return View([Emit(F.col("n_regionkey"))]).query(of(spark, d, "nation"), keys=[3, 1, "x"]).select("id", "k0")


@query("SELECT 'nation:' || n_nationkey AS id, n_regionkey AS k0 FROM nation JOIN (VALUES (1), (3), (3)) v(k) ON n_regionkey = k")
def view_keys_table(spark, d):
    keys = spark.createDataFrame([(1,), (3,), (3,)], "key int")
    return View([Emit(F.col("n_regionkey"))]).by_keys(of(spark, d, "nation"), keys).select("id", "k0")


@query("SELECT 'nation:' || n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey = 2")
def view_include_docs(spark, d):
    return View([Emit(F.col("n_regionkey"))]).query(of(spark, d, "nation"), key=2, include_docs=True).select("id", F.col("doc.n_name").alias("name"))


@query("SELECT 'nation:' || n_nationkey AS id FROM nation WHERE n_regionkey >= 1 AND 'nation:' || n_nationkey BETWEEN 'nation:1' AND 'nation:19'")
def view_docid_bounds(spark, d):
    return View([Emit(F.col("n_regionkey"))]).query(of(spark, d, "nation"), startkey=1, startkey_docid="nation:1", endkey_docid="nation:19").select("id")


@query("SELECT c_nationkey AS k0, count(*) AS value FROM customer WHERE c_nationkey BETWEEN 3 AND 9 GROUP BY ALL ORDER BY k0 LIMIT 4 OFFSET 1")
def view_reduce_page(spark, d):
    return View([Emit(F.col("c_nationkey"))], "_count").query(of(spark, d, "customer"), startkey=3, endkey=9, group=True, skip=1, limit=4)


@query("SELECT (SELECT count(*) FROM orders) AS total_rows, (SELECT count(*) FROM orders WHERE o_totalprice < 100000) + 5 AS offset, NULL::BIGINT AS update_seq")
def view_metadata(spark, d):
    return View([Emit(F.col("o_totalprice"))]).metadata(of(spark, d, "orders"), startkey=100000, skip=5)


@query("WITH l AS (SELECT arg_max(event_type, event_id) AS t, arg_max(value, event_id) AS v FROM events GROUP BY user_id) SELECT t AS k0, count(*) AS n, round(sum(v), 3) AS total FROM l WHERE t NOT IN ('purchase', 'view') GROUP BY t")
def view_materialised(spark, d):
    """A view of the users' latest events, kept as a table by a stream that drains the log; deleted and filtered ones are not in it."""
    out, progress = (new_folder(spark, name) for name in ("view", "progress"))
    events = table(spark, d, "events")
    stream = _as_log(spark.readStream.schema(events.schema).parquet(f"{d}/events*.parquet"))
    view = View([Emit(F.col("event_type"), F.col("value"), when=F.col("event_type") != "view")])
    maintain(view, stream, out, progress).awaitTermination()
    return maintained(spark, out).groupBy("k0").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("SELECT o_orderstatus AS k0, true AS within FROM orders GROUP BY ALL")
def view_approx_distinct(spark, d):
    """Estimates are within five hundredths of the exact count in every group."""
    c = of(spark, d, "orders")
    view = View([Emit([F.col("o_orderstatus"), F.col("o_custkey")])], "_approx_count_distinct")
    exact = c.docs.groupBy(F.col("o_orderstatus").alias("k0")).agg(F.countDistinct("o_custkey").alias("exact"))
    return view.query(c, group_level=1).join(exact, "k0").select("k0", (F.abs(F.col("value") - F.col("exact")) <= 0.05 * F.col("exact")).alias("within"))


def _most(frame, by):
    return frame.groupby(by, as_index=False).agg(top=("value", "max"), n=("value", "size"))


def _spread(key, frame):
    import pandas as pd

    return pd.DataFrame([[*key, float(frame["top"].max()), int(frame["n"].sum())]])


@query("SELECT l_returnflag AS k0, max(l_extendedprice) AS top, count(*) AS n FROM lineitem GROUP BY ALL")
def view_custom_reduce(spark, d):
    how = GroupedReduce(_spread, "top double, n long", partial=_most, partial_schema="top double, n long")
    return View([Emit(F.col("l_returnflag"), F.col("l_extendedprice"))], how).query(of(spark, d, "lineitem"), group=True)


@query("SELECT 'orders:' || o_orderkey AS id, o_orderstatus AS k0, o_totalprice AS value FROM orders WHERE o_orderstatus >= 'O' ORDER BY k0, id LIMIT 100 OFFSET 30")
def view_default_page(spark, d):
    return View([Emit(F.col("o_orderstatus"), F.col("o_totalprice"))], "_count").query(of(spark, d, "orders"), startkey="O", reduce=False, skip=30)


@query("SELECT round(sum(l_quantity), 2) AS sum, min(l_quantity) AS min, max(l_quantity) AS max, count(*) AS count, round(sum(l_quantity * l_quantity), 2) AS sumsqr FROM lineitem")
def view_stats_global(spark, d):
    out = View([Emit(F.col("l_returnflag"), F.col("l_quantity"))], "_stats").query(of(spark, d, "lineitem"))
    return out.withColumn("sum", F.round("sum", 2)).withColumn("sumsqr", F.round("sumsqr", 2))


@query("SELECT l_returnflag AS k0, l_linestatus AS k1, year(l_shipdate)::INT AS k2, count(*) AS value FROM lineitem GROUP BY ROLLUP (1, 2, 3)")
def view_all_levels(spark, d):
    return all_levels(_flags(), of(spark, d, "lineitem")).drop("gid")


@query("SELECT 1 AS part, count(*) AS value FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 2, count(*) FROM orders WHERE o_orderstatus >= 'O'")
def view_multi_query(spark, d):
    a, b = View([Emit(F.col("o_orderstatus"))], "_count").queries(of(spark, d, "orders"), [{"key": "F"}, {"startkey": "O"}])
    return a.select(F.lit(1).alias("part"), "value").unionByName(b.select(F.lit(2).alias("part"), "value"))


@query("SELECT n_regionkey::BIGINT AS k0, count(*) AS value FROM nation GROUP BY ALL")
def view_partitioned(spark, d):
    return View([Emit(F.col("number"))], "_count").query(_mixed(spark, d), partition="nation", group=True)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS k0, count(*) AS value, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def view_time_windows(spark, d):
    e = table(spark, d, "events")
    rows = e.select(F.window("ts", "1 hour")["start"].alias("start"), F.col("event_type").alias("k0"), "value")
    return rows.groupBy("start", "k0").agg(F.count(F.lit(1)).alias("value"), F.round(F.sum("value"), 3).alias("total"))


def _initials(doc):
    first, *rest = doc["p_name"].split(" ")
    yield (first[0], len(rest)), doc["p_size"]


@query("SELECT p_name[1] AS k0, len(string_split(p_name, ' ')) - 1 AS k1, sum(p_size)::BIGINT AS value FROM part GROUP BY ALL")
def view_python_map(spark, d):
    view = PythonView(reduce="_sum", function=_initials, key="k0 string, k1 long", value="long", columns=["p_name", "p_size"])
    return view.query(of(spark, d, "part"), group=True, limit=None)


@query("SELECT (SELECT count(*) FROM orders) AS docs_examined, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS results_returned")
def find_stats(spark, d):
    from pyspark.sql import Observation

    seen = Observation("find")
    n = of(spark, d, "orders").find({"o_orderstatus": "P"}, limit=None, stats=seen).count()
    return spark.createDataFrame([(seen.get["docs_examined"], n)], "docs_examined long, results_returned long")


# -- revisions -----------------------------------------------------------------------------


def _revisions(spark, d) -> DataFrame:
    """Events as revisions of users: generations by threes of events, so that generations have several branches."""
    e = table(spark, d, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    rev = F.concat_ws("-", F.ceil(F.col("n") / 3).cast("string"), F.md5(F.col("event_id").cast("string")))
    return e.select(F.col("user_id").cast("string").alias("_id"), rev.alias("_rev"), (F.col("event_type") == "purchase").alias("_deleted"), F.array(rev).alias("_rev_history"), "value", F.col("event_id").alias("_seq"))


_REV_SQL = "r AS (SELECT user_id::VARCHAR AS id, ceil(row_number() OVER (PARTITION BY user_id ORDER BY event_id) / 3)::INT AS g, md5(event_id::VARCHAR) AS h, event_type = 'purchase' AS del, event_id FROM events)"


@query(f"WITH {_REV_SQL} SELECT id AS _id, arg_max(g || '-' || h, (g, h)) AS _rev FROM r GROUP BY id")
def rev_winner(spark, d):
    return R.winners(_revisions(spark, d)).select("_id", "_rev")


@query(f"WITH {_REV_SQL} SELECT id AS _id, count(*) - 1 AS n, arg_max(g || '-' || h, (g, h)) AS winner FROM r GROUP BY id")
def rev_conflicts(spark, d):
    return R.conflicts(_revisions(spark, d)).select("_id", "winner", F.size("conflicts").cast("long").alias("n"))


@query(f"WITH {_REV_SQL}, w AS (SELECT id, arg_max(g || '-' || h, (g, h)) AS w FROM r GROUP BY id) SELECT id AS _id, count(*) FILTER (del AND g || '-' || h <> w) AS n FROM r JOIN w USING (id) GROUP BY id")
def rev_deleted_conflicts(spark, d):
    return R.conflicts(_revisions(spark, d), deleted=True).select("_id", F.size("conflicts").cast("long").alias("n"))


@query(f"WITH {_REV_SQL} SELECT id AS _id, list_aggregate(list_sort(list(g || '-' || h)), 'string_agg', ',') AS missing FROM r WHERE event_id % 5 = 0 GROUP BY id")
def revs_diff(spark, d):
    all_revs = _revisions(spark, d)
    known = all_revs.where("_seq % 5 <> 0")
    return R.revs_diff(all_revs, known).select("_id", F.array_join("missing", ",").alias("missing"))


@query(f"WITH {_REV_SQL} SELECT id AS _id, g || '-' || h AS _rev FROM r WHERE event_id % 4 = 1")
def missing_revs(spark, d):
    all_revs = _revisions(spark, d)
    return R.missing_revisions(all_revs, all_revs.where("_seq % 4 <> 1"))


def _chains(spark, d) -> DataFrame:
    """Users' events as one line of revisions each, every one with the history before it."""
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    one = F.concat_ws("-", F.row_number().over(w).cast("string"), F.md5(F.col("event_id").cast("string")))
    e = e.withColumn("_rev", one)
    history = F.reverse(F.collect_list("_rev").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.select(F.col("user_id").cast("string").alias("_id"), "_rev", history.alias("_rev_history"), "value", F.col("event_id").alias("_seq"))


def _leaves(spark, d, before: int | None = None) -> DataFrame:
    """The leaf of each user's line of revisions, with its history: what a replica holds."""
    e = table(spark, d, "events")
    e = e if before is None else e.where(F.col("event_id") < before)
    held = e.groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("ids"), F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("_seq"))
    history = F.reverse(F.transform("ids", lambda x, i: F.concat_ws("-", (i + 1).cast("string"), F.md5(x.cast("string")))))
    return held.select(F.col("user_id").cast("string").alias("_id"), history[0].alias("_rev"), F.slice(history, 1, R.REVS_LIMIT).alias("_rev_history"), "value", "_seq")


@query("SELECT user_id::VARCHAR AS _id, count(*) || '-' || md5(max(event_id)::VARCHAR) AS _rev FROM events GROUP BY user_id")
def rev_leaves(spark, d):
    return R.leaves_of(_chains(spark, d)).select("_id", "_rev")


@query("SELECT user_id::VARCHAR AS _id, count(*)::INT AS start, least(count(*), 5)::INT AS n FROM events GROUP BY user_id")
def rev_history_field(spark, d):
    done = R.compact(_leaves(spark, d), 5)
    return done.select("_id", R.revisions_field().alias("r")).select("_id", "r.start", F.size("r.ids").alias("n"))


@query(f"WITH {_REV_SQL} SELECT id AS _id, g || '-' || h AS _rev FROM r WHERE id = '7'")
def rev_open(spark, d):
    """All leaves of one document."""
    return R.open_revs(R.leaves_of(_revisions(spark, d)), "7").select("_id", "_rev")


@query(f"WITH {_REV_SQL}, x AS (SELECT * FROM r WHERE id = '7'), w AS (SELECT arg_max(g || '-' || h, (g, h)) AS w, arg_max(g, (g, h)) AS g, arg_max(event_id, (g, h)) AS e FROM x) SELECT '7' AS _id, w AS _rev, w.g AS start, (SELECT count(*) FROM x WHERE NOT del AND g || '-' || h <> w) AS conflicts, (SELECT count(*) FROM x WHERE del AND g || '-' || h <> w) AS deleted_conflicts, e AS _local_seq FROM w")
def document_with_revisions(spark, d):
    """One read of a document with all that is known of its revisions."""
    found = R.read_document(_revisions(spark, d), "7", revs=True, revs_info=True, conflicts=True, deleted_conflicts=True, local_seq=True)
    return found.select("_id", "_rev", "_revisions.start", F.size("_conflicts").cast("long").alias("conflicts"), F.size("_deleted_conflicts").cast("long").alias("deleted_conflicts"), "_local_seq")


@query("WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS m FROM events WHERE user_id = 7) SELECT n || '-' || md5(event_id::VARCHAR) AS rev, CASE WHEN n = m THEN 'available' ELSE 'missing' END AS status FROM r")
def document_revs_info(spark, d):
    """The line of a document whose older revisions are known by name only."""
    found = R.read_document(_leaves(spark, d), "7", revs_info=True)
    return found.select(F.explode("_revs_info").alias("i")).select("i.rev", "i.status")


@query(f"WITH {_REV_SQL}, x AS (SELECT id, CASE WHEN event_id % 7 = 0 AND NOT del THEN g + 1 ELSE g END AS g, del OR event_id % 7 = 0 AS del FROM r) SELECT id AS _id, count(*) AS leaves, count(*) FILTER (del) AS gone, max(g)::INT AS generation FROM x GROUP BY id")
def delete_conflict_leaves(spark, d):
    """Leaves are deleted, winners or not; their tombstones are leaves, and winners are found anew."""
    leaves = _revisions(spark, d)
    done = R.apply_writes(leaves, R.delete_leaves(leaves, leaves.where("_seq % 7 = 0")))
    winners = R.winners(done).select("_id", R.generation("_rev").alias("generation"))
    return done.groupBy("_id").agg(F.count(F.lit(1)).alias("leaves"), F.count_if("_deleted").alias("gone")).join(winners, "_id").select("_id", "leaves", "gone", "generation")


@query(
    """WITH cur AS (SELECT user_id::VARCHAR AS id, count(*) AS g, count(*) || '-' || md5(max(event_id)::VARCHAR) AS rev FROM events GROUP BY user_id),
    inc AS (SELECT id, rev, g, CASE WHEN id::BIGINT % 3 = 0 THEN rev WHEN id::BIGINT % 3 = 1 THEN '1-stale' END AS given FROM cur UNION ALL SELECT 'new', NULL, 0, NULL)
    SELECT id AS _id, CASE WHEN given IS NOT DISTINCT FROM rev THEN 'ok' ELSE 'conflict' END AS status, CASE WHEN given IS NOT DISTINCT FROM rev THEN g + 1 END::INT AS generation FROM inc"""
)
def bulk_docs(spark, d):
    current = _leaves(spark, d).drop("_seq")
    third = F.col("_id").cast("long") % 3
    incoming = current.select("_id", F.when(third == 0, F.col("_rev")).when(third == 1, "1-stale").alias("_rev"), F.lit(1.0).alias("value"))
    incoming = incoming.unionByName(spark.createDataFrame([("new", None, 2.0)], "_id string, _rev string, value double")).withColumn("pos", F.lit(0))
    out = R.bulk_docs(current, incoming)
    return out.select("_id", "status", F.when(F.col("new_rev").isNotNull(), R.generation("new_rev")).alias("generation"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'forbidden' ELSE 'ok' END AS status FROM customer")
def bulk_docs_validated(spark, d):
    """New documents, those of them written that a rule accepts."""
    incoming = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("_id"), F.lit(None).cast("string").alias("_rev"), F.lit(0).alias("pos"), "c_custkey", "c_acctbal")
    current = spark.createDataFrame([], "_id string, _rev string, _rev_history array<string>")
    return R.bulk_docs(current, incoming, R.first_failure([(F.col("c_acctbal") >= 0, "negative balance")])).select("c_custkey", "status")


_CUR = "cur AS (SELECT user_id::VARCHAR AS id, count(*) AS g, count(*) || '-' || md5(max(event_id)::VARCHAR) AS rev, arg_max(value, event_id) AS v FROM events GROUP BY user_id)"


@query(f"WITH {_CUR} SELECT id AS _id, CASE WHEN id::BIGINT % 3 = 0 THEN g + 1 ELSE g END::INT AS generation, id::BIGINT % 3 = 0 AND id::BIGINT % 2 = 0 AS gone, CASE WHEN id::BIGINT % 3 = 0 THEN -1.0::DOUBLE ELSE v END AS value FROM cur")
def write_and_delete(spark, d):
    """A third of the documents is written anew, every second of those as a tombstone; each id keeps one leaf."""
    current = _leaves(spark, d).drop("_seq").withColumn("_deleted", F.lit(False))
    n = F.col("_id").cast("long")
    incoming = current.where(n % 3 == 0).select("_id", "_rev", F.lit(0).alias("pos"), (n % 2 == 0).alias("_deleted"), F.lit(-1.0).alias("value"))
    return R.apply_writes(current, R.bulk_docs(current, incoming)).select("_id", R.generation("_rev").alias("generation"), F.col("_deleted").alias("gone"), "value")


@query(f"WITH {_CUR} SELECT id AS _id, CASE WHEN v > 50 THEN g + 1 ELSE g END::INT AS generation, CASE WHEN v > 50 THEN round(v / 2, 6) ELSE round(v, 6) END AS value FROM cur")
def update_function(spark, d):
    """An update function halves large values; what it gives back is written as a batch."""
    current = _leaves(spark, d).drop("_seq").withColumn("_deleted", F.lit(False))
    changed = update(current.where(F.col("value") > 50), lambda docs: docs.select("_id", "_rev", F.lit(0).alias("pos"), "_deleted", (F.col("value") / 2).alias("value")))
    return R.apply_writes(current, R.bulk_docs(current, changed)).select("_id", R.generation("_rev").alias("generation"), F.round("value", 6).alias("value"))


@query(f"WITH {_CUR} SELECT id AS _id, count(*) AS leaves, max(rev) AS winner FROM (SELECT id, rev FROM cur UNION ALL SELECT id, '1-0' FROM cur WHERE id::BIGINT % 4 = 0) GROUP BY id")
def write_given_revisions(spark, d):
    """Revisions as they come from a replica: a branch of its own stays a leaf beside the winner."""
    ours = _leaves(spark, d).drop("_seq")
    theirs = ours.where(F.col("_id").cast("long") % 4 == 0).withColumn("_rev", F.lit("1-0")).withColumn("_rev_history", F.array(F.lit("1-0")))
    merged = R.merge_revisions(ours, theirs.unionByName(ours))
    return merged.groupBy("_id").agg(F.count(F.lit(1)).alias("leaves"), F.max_by("_rev", R.rank()).alias("winner"))


@query(f"WITH {_CUR} SELECT id AS _id, rev AS _rev FROM cur WHERE v < 20")
def purge_revisions(spark, d):
    ours = _leaves(spark, d)
    return R.purge(ours, ours.where("value >= 20")).select("_id", "_rev")


@query("SELECT 'nation:copy' AS _id, n_name FROM nation WHERE n_nationkey = 6")
def copy_document(spark, d):
    return R.copy_document(of(spark, d, "nation").docs, "nation:6", "nation:copy").select("_id", "n_name")


@query("SELECT user_id::VARCHAR AS _id, count(*)::INT AS n, true AS same FROM events GROUP BY user_id")
def rev_history_decoded(spark, d):
    """A history goes to ``{start, ids}`` and back."""
    rows = _leaves(spark, d).withColumn("r", R.revisions_field())
    return rows.select("_id", F.size("r.ids").alias("n"), (R.history_of(F.col("r.start"), F.col("r.ids")) == F.col("_rev_history")).alias("same"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'negative balance' WHEN c_nationkey > 20 THEN 'unknown nation' END AS error FROM customer")
def validate_documents(spark, d):
    rules = [(F.col("c_acctbal") >= 0, "negative balance"), (F.col("c_nationkey") <= 20, "unknown nation")]
    return of(spark, d, "customer").docs.select("c_custkey", R.first_failure(rules).alias("error"))


# -- changes and replication -------------------------------------------------------------


def _log(spark, d) -> DataFrame:
    return _as_log(table(spark, d, "events"))


def _as_log(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("_seq"), F.col("user_id").cast("string").alias("_id"), F.concat_ws("-", F.lit("1"), F.md5(F.col("event_id").cast("string"))).alias("_rev"), (F.col("event_type") == "purchase").alias("_deleted"), "event_type", "value")


_LAST = "l AS (SELECT max(event_id) AS seq, user_id::VARCHAR AS id, arg_max(event_type, event_id) AS t, arg_max(value, event_id) AS v FROM events GROUP BY user_id)"


@query(f"WITH {_LAST} SELECT seq, id, t = 'purchase' AS deleted FROM l WHERE seq > 5000 ORDER BY seq LIMIT 50")
def changes_since(spark, d):
    return Feed(_log(spark, d)).changes(since=5000, limit=50).drop("changes")


@query(f"WITH {_LAST} SELECT seq, id FROM l WHERE t = 'click' AND v > 10")
def changes_selector(spark, d):
    return Feed(_log(spark, d), [by_selector({"event_type": "click", "value": {"$gt": 10}})]).changes(limit=None).select("seq", "id")


@query(f"WITH {_LAST} SELECT seq, id FROM l WHERE id IN ('1', '2', '3', '50') ORDER BY seq DESC LIMIT 3")
def changes_ids_descending(spark, d):
    return Feed(_log(spark, d), [by_ids(["1", "2", "3", "50"])]).changes(limit=3, descending=True).select("seq", "id")


@query(f"WITH {_LAST} SELECT seq, id FROM l WHERE id::BIGINT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def changes_id_table(spark, d):
    wanted = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").cast("string").alias("id"))
    return Feed(_log(spark, d), [by_id_table(wanted)]).changes(limit=None).select("seq", "id")


@query(f"WITH {_LAST} SELECT seq, id FROM l WHERE t IN ('click', 'view') AND v < 5")
def changes_view_filter(spark, d):
    """Documents for which a view's map emits a row."""
    view = View([Emit(F.col("event_type"), when=F.col("event_type").isin("click", "view") & (F.col("value") < 5))])
    return Feed(_log(spark, d), [by_condition(view.emits[0].when)]).changes(limit=None).select("seq", "id")


@query("SELECT max(event_id) AS seq, '_design/' || user_id AS id FROM events WHERE user_id % 10 = 0 GROUP BY user_id")
def changes_design_only(spark, d):
    log = _log(spark, d).withColumn("_id", F.concat(F.when(F.col("_id").cast("long") % 10 == 0, "_design/").otherwise(""), "_id"))
    return Feed(log, [design_only]).changes(limit=None).select("seq", "id")


@query("SELECT max(event_id) AS last_seq, 0::BIGINT AS pending FROM events")
def changes_since_now(spark, d):
    return Feed(_log(spark, d)).pending(since="now")


@query(f"WITH {_LAST} SELECT seq, id, t = 'purchase' AS deleted FROM l")
def changes_stream(spark, d):
    """The feed as a stream that drains the log in micro-batches; what each delivers is appended to a table, whose latest rows are the feed."""
    out, progress = (new_folder(spark, name) for name in ("changes", "progress"))
    events = table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events*.parquet")
    follow(_as_log(stream), lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/batch={n}"), progress).awaitTermination()
    return Feed(spark.read.parquet(out)).changes(limit=None).drop("changes")


@query(f"WITH {_LAST}, p AS (SELECT seq FROM l WHERE seq > 100 ORDER BY seq LIMIT 20) SELECT (SELECT max(seq) FROM p) AS last_seq, (SELECT count(*) FROM l WHERE seq > 100) - (SELECT count(*) FROM p) AS pending")
def changes_pending(spark, d):
    return Feed(_log(spark, d)).pending(since=100, limit=20)


@query(f"WITH {_REV_SQL}, x AS (SELECT id, max(event_id) AS seq, count(*) AS n FROM r GROUP BY id) SELECT seq, id, n::INT AS n FROM x")
def changes_all_leaves(spark, d):
    revs = _revisions(spark, d)
    return Feed(revs, leaves=revs).changes(limit=None).select("seq", "id", F.size("changes").alias("n"))


@query(f"WITH {_LAST} SELECT seq, id, v AS value FROM l WHERE seq > 9000")
def changes_include_docs(spark, d):
    return Feed(_log(spark, d)).changes(since=9000, limit=None, include_docs=True).select("seq", "id", F.col("doc.value").alias("value"))


@query("SELECT user_id::VARCHAR AS _id, count(*) || '-' || md5(max(event_id)::VARCHAR) AS _rev FROM events GROUP BY user_id")
def replicate_one_shot(spark, d):
    return replicate(_leaves(spark, d), _leaves(spark, d, before=4000)).select("_id", "_rev")


@query("SELECT user_id::VARCHAR AS _id, count(*) || '-' || md5(max(event_id)::VARCHAR) AS _rev FROM events WHERE user_id <= 50 OR event_id < 4000 GROUP BY user_id")
def replicate_filtered(spark, d):
    """Only documents of a selector are sent; the others stay as the target has them."""
    wanted = lambda rows: rows.where(F.col("_id").cast("long") <= 50)
    return replicate(_leaves(spark, d), _leaves(spark, d, before=4000), filters=[wanted]).select("_id", "_rev")


@query("SELECT coalesce(max(o_orderkey), 0) AS since FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders WHERE o_orderstatus <> 'P') AND o_orderkey = (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate = (SELECT max(o_orderdate) FROM orders WHERE o_orderstatus <> 'P'))")
def replication_checkpoint(spark, d):
    """Orders as sessions: the newest that the other side, which lacks some, knows as well."""
    ours = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("session_id"), F.col("o_orderkey").alias("last_seq"), F.struct("o_orderdate", "o_orderkey").alias("at"), "o_orderstatus")
    return common_checkpoint(ours, ours.where("o_orderstatus <> 'P'"))


# -- search --------------------------------------------------------------------------------


_STOPS = """('a', 'an', 'and', 'are', 'as', 'at', 'be', 'but', 'by', 'for', 'if', 'in', 'into', 'is', 'it', 'no', 'not', 'of', 'on', 'or', 'such', 'that', 'the', 'their', 'then', 'there', 'these', 'they', 'this', 'to', 'was', 'will', 'with')"""


def _index(spark, d) -> SearchIndex:
    c = of(spark, d, "documents")
    return SearchIndex(c, {"text": IndexField(F.col("text")), "lang": IndexField(F.col("lang"), store=True, facet=True), "source": IndexField(F.col("source"), store=True, facet=True), "n_chars": IndexField(F.col("n_chars"), kind="number", store=True)}, id_col="doc_id")


_TOK = r"t AS (SELECT doc_id, lang, source, n_chars, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)"


@query(rf"WITH {_TOK} SELECT doc_id FROM t WHERE list_contains(w, 'retitioning') OR list_contains(w, 'ouen')")
def search_term_any(spark, d):
    return _index(spark, d).hits(Term("Retitioning ouen", "text")).select("doc_id")


@query(rf"WITH {_TOK} SELECT doc_id FROM t WHERE list_contains(w, 'ing') AND list_contains(w, 'ha')")
def search_and(spark, d):
    return _index(spark, d).hits(Term("ing", "text") & Term("ha", "text")).select("doc_id")


@query(rf"WITH {_TOK} SELECT doc_id FROM t WHERE list_contains(w, 'que') OR list_contains(w, 'und')")
def search_or(spark, d):
    return _index(spark, d).hits(Term("que", "text") | Term("und", "text")).select("doc_id")


@query(rf"WITH {_TOK} SELECT doc_id FROM t WHERE NOT list_contains(w, 'tion')")
def search_not(spark, d):
    return _index(spark, d).hits(~Term("tion", "text")).select("doc_id")


@query(rf"WITH {_TOK} SELECT doc_id FROM t WHERE contains(' ' || array_to_string(list_filter(w, lambda x: x NOT IN ('a','an','and','are','as','at','be','but','by','for','if','in','into','is','it','no','not','of','on','or','such','that','the','their','then','there','these','they','this','to','was','will','with')), ' ') || ' ', ' rights reserved ')")
def search_phrase(spark, d):
    return _index(spark, d).hits(Phrase("rights reserved", "text")).select("doc_id")


@query(rf"WITH {_TOK} SELECT doc_id FROM t WHERE len(list_filter(w, lambda x: regexp_full_match(x, 'ret.*ing'))) > 0")
def search_wildcard(spark, d):
    return _index(spark, d).hits(Wildcard("ret*ing", "text")).select("doc_id")


@query(rf"WITH {_TOK} SELECT doc_id FROM t WHERE list_contains(w, 'de') OR lower(lang) = 'de' OR list_contains(regexp_extract_all(lower(source), '[\p{{L}}\p{{N}}]+'), 'de')")
def search_all_fields(spark, d):
    """A term without a field is looked for in all text fields."""
    return _index(spark, d).hits(Term("de")).select("doc_id")


@query("SELECT doc_id, lang, source, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 25")
def search_everything(spark, d):
    return _index(spark, d).search(Everything(), sort=["n_chars"])


@query(rf"WITH {_TOK} SELECT doc_id FROM t WHERE (list_contains(w, 'que') OR list_contains(w, 'und')) AND NOT (list_contains(w, 'die') AND n_chars < 2000)")
def search_nested(spark, d):
    return _index(spark, d).hits((Term("que", "text") | Term("und", "text")) & ~(Term("die", "text") & NumberRange("n_chars", high=2000))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang = 'de' AND n_chars >= 500 AND n_chars < 1500")
def search_field_and_range(spark, d):
    return _index(spark, d).hits(Term("de", "lang") & NumberRange("n_chars", 500, 1500)).select("doc_id")


@query("SELECT count(*) AS total_rows FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en'")
def search_drilldown(spark, d):
    return _index(spark, d).total(Everything(), drilldown=[("source", ["src1", "src2"]), ("lang", ["en"])])


@query("SELECT 'lang' AS field, lang AS term, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY ALL")
def search_counts(spark, d):
    return _index(spark, d).counts(Everything(), ["lang", "source"])


@query("SELECT 'n_chars' AS field, 'short' AS label, count(*) FILTER (n_chars < 1000) AS n FROM documents UNION ALL SELECT 'n_chars', 'long', count(*) FILTER (n_chars >= 1000) FROM documents")
def search_ranges(spark, d):
    return _index(spark, d).ranges(Everything(), {"n_chars": {"short": (None, 1000), "long": (1000, None)}})


@query('SELECT lang AS "group", count(*) OVER (PARTITION BY lang) AS total_rows, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id)::INT AS place, doc_id FROM documents QUALIFY place <= 2')
def search_group(spark, d):
    return _index(spark, d).groups(Everything(), "lang", group_limit=2, sort=["-n_chars"])


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'fr' ORDER BY n_chars DESC, doc_id LIMIT 10 OFFSET 5")
def search_sort_page(spark, d):
    return _index(spark, d).search(Term("fr", "lang"), sort=["-n_chars"], limit=10, bookmark=5, include_fields=["lang", "n_chars"])


_BM25 = rf"""WITH {_TOK}, k AS (SELECT doc_id, list_filter(w, lambda x: x NOT IN _STOPS_) AS w FROM t),
f AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'tion')) AS a, len(list_filter(w, lambda x: x = 'ing')) AS b FROM k),
s AS (SELECT avg(n) AS size, ln(1 + (count(*) - count(*) FILTER (a > 0) + 0.5) / (count(*) FILTER (a > 0) + 0.5)) AS ia, ln(1 + (count(*) - count(*) FILTER (b > 0) + 0.5) / (count(*) FILTER (b > 0) + 0.5)) AS ib FROM f),
x AS (SELECT doc_id, ia * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / size)) + ib * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / size)) AS score FROM f, s WHERE a + b > 0)
SELECT doc_id, round(score, 6) AS score FROM x""".replace("_STOPS_", _STOPS)


@query(_BM25)
def search_scored(spark, d):
    """The score of every hit, whose order ``search`` pages through."""
    index = _index(spark, d)
    query = Term("tion ing", "text")
    return index.scored(query, index.hits(query)).select("doc_id", F.round("score", 6).alias("score"))


@query(rf"WITH {_TOK} SELECT doc_id, n_chars AS doc_chars FROM t WHERE list_contains(w, 'que') ORDER BY n_chars, doc_id LIMIT 25")
def search_include_docs(spark, d):
    return _index(spark, d).search(Term("que", "text"), sort=["n_chars"], include_docs=True).select("doc_id", F.col("doc.n_chars").alias("doc_chars"))


@query(rf"WITH {_TOK}, k AS (SELECT *, list_filter(w, lambda x: x NOT IN _STOPS_) AS v FROM t) SELECT doc_id FROM k WHERE (list_contains(v, 'que') OR list_contains(v, 'ing')) AND NOT (list_contains(v, 'die') AND n_chars < 2000) OR contains(' ' || array_to_string(v, ' ') || ' ', ' rights reserved ') OR len(list_filter(v, lambda x: regexp_full_match(x, 'ret.*ing'))) > 0".replace("_STOPS_", _STOPS))
def search_by_postings(spark, d):
    """Words, a phrase, a wildcard and a range, answered from stored postings."""
    index = _index(spark, d).write_postings(new_folder(spark, "postings"))
    query = ((Term("que", "text") | Term("ing", "text")) & ~(Term("die", "text") & NumberRange("n_chars", high=2000))) | Phrase("rights reserved", "text") | Wildcard("ret*ing", "text")
    return index.hits(query).select("doc_id")


_EDGE = r"[^\p{L}\p{N}]"
_MARKED = r"[^\p{L}\p{N}\x01\x02]"


@query(
    _BM25.replace("SELECT doc_id, round(score, 6) AS score FROM x", "")
    + ", page AS (SELECT doc_id, lang, source, n_chars, text FROM x JOIN documents USING (doc_id) ORDER BY score DESC, doc_id LIMIT 25), "
    + rf"hits AS (SELECT *, length(regexp_extract(' ' || text || ' ', '(?is)^(.*?{_EDGE})(?:tion|ing){_EDGE}', 1)) AS place FROM page), "
    + "parts AS (SELECT *, ' ' || substring(text, greatest(1, place - 50), 200) || ' ' AS part FROM hits), "
    + rf"firsts AS (SELECT *, regexp_replace(part, '(?i)({_MARKED})(tion|ing)({_MARKED})', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g') AS once FROM parts), "
    + rf"marked AS (SELECT *, regexp_replace(once, '(?i)({_MARKED})(tion|ing)({_MARKED})', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g') AS twice FROM firsts) "
    + "SELECT doc_id, lang, source, n_chars, replace(replace(substring(twice, 2, length(twice) - 2), chr(1), '<em>'), chr(2), '</em>') AS highlight_text FROM marked"
)
def search_ranked(spark, d):
    return _index(spark, d).search(Term("tion ing", "text"), limit=25, highlight_fields=["text"])


_WORDS = r"list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'), lambda x: x NOT IN {})"


@query(
    "WITH f AS (" + " UNION ALL ".join(f"SELECT doc_id, '{c}' AS field, {_WORDS.format(c, _STOPS)} AS w FROM documents" for c in ("text", "lang", "source")) + "), p AS (SELECT doc_id, field, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM f) "
    "SELECT field, term, doc_id, pos::INT AS pos FROM p"
)
def search_postings(spark, d):
    """All postings of all text fields."""
    return _index(spark, d).postings().withColumnRenamed("id", "doc_id")


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> ''))::INT AS n FROM documents")
def search_analyze(spark, d):
    from ..functions.text import whitespace_tokens

    return table(spark, d, "documents").select("doc_id", F.size(whitespace_tokens(F.col("text"))).alias("n"))
