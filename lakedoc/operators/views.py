"""Map/reduce views.

A view maps each live document to any number of (key, value) rows, given as columns; keys of
several columns are arrays. Queries filter by collation order, group by a key prefix, reduce
natively with partial aggregation, sort and page. Views are lazy plans and so are never stale.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.collation import compare, key_in
from .collection import Collection, with_docs

DEFAULT_LIMIT = 100


@dataclass
class Emit:
    """One row of a map: key columns, a value, and the condition under which it is emitted.

    ``each``: an array column; the row is emitted for each of its elements, which ``key`` and ``value`` then get.
    """

    key: Column | Sequence[Column] | Callable[[Column], Column | Sequence[Column]]
    value: Column | Callable[[Column], Column] | None = None
    when: Column | None = None
    each: Column | None = None


def _columns(key) -> list[Column]:
    return list(key) if isinstance(key, (list, tuple)) else [key]


@dataclass
class View:
    """``emits``: rows per document. ``reduce``: _count, _sum, _stats, _approx_count_distinct or a GroupedReduce."""

    emits: Sequence[Emit]
    reduce: str | GroupedReduce | None = None

    def rows(self, collection: Collection) -> DataFrame:
        """``id, k0.., value`` of all live documents; a single scan whatever the number of emits."""
        docs = collection.live().docs
        parts = []
        for e in self.emits:
            if e.each is None:
                parts.append((F.array(self._row(e, None)), e.when))
            else:
                empty = F.array().cast(docs.select(e.each.alias("each")).schema["each"].dataType)
                parts.append((F.transform(F.coalesce(e.each, empty), self._row_of(e)), e.when))
        none = lambda a: F.slice(a, 1, 0)
        arrays = [a if w is None else F.when(w, a).otherwise(none(a)) for a, w in parts]
        if len(arrays) == 1 and self.emits[0].each is None:
            e = self.emits[0]
            docs = docs if e.when is None else docs.where(e.when)
            row = self._plain(e)
            return docs.select(F.col("_id").alias("id"), *row)
        joined = arrays[0] if len(arrays) == 1 else F.concat(*arrays)
        return docs.select(F.col("_id").alias("id"), F.explode(joined).alias("e")).select("id", "e.*")

    @staticmethod
    def _plain(e: Emit) -> list[Column]:
        value = e.value if e.value is not None else F.lit(None).cast("string")
        return [*[k.alias(f"k{i}") for i, k in enumerate(_columns(e.key))], value.alias("value")]

    def _row_of(self, e: Emit) -> Callable[[Column], Column]:
        return lambda x: self._row(e, x)

    @staticmethod
    def _row(e: Emit, x: Column | None) -> Column:
        key = e.key(x) if callable(e.key) and not isinstance(e.key, Column) else e.key
        value = e.value(x) if callable(e.value) and not isinstance(e.value, Column) else e.value
        return F.struct(*[k.alias(f"k{i}") for i, k in enumerate(_columns(key))], (value if value is not None else F.lit(None).cast("string")).alias("value"))

    def query(
        self, collection: Collection, *, startkey=None, endkey=None, key=None, keys: list | None = None, inclusive_end: bool = True, startkey_docid: str | None = None, endkey_docid: str | None = None,
        descending: bool = False, reduce: bool | None = None, group: bool = False, group_level: int = 0, skip: int = 0, limit: int | None = DEFAULT_LIMIT, include_docs: bool = False, partition: str | None = None, sort: bool = False,
    ) -> DataFrame:
        """Rows ``id, k0.., value`` of the map, or groups of the reduction.

        Omitted bounds are unbounded; a bound of ``(None,)`` is the key null. ``group_level`` wins over ``group``; without either, all
        rows form one group, and there is none if no row is in range. ``limit=None`` returns all rows, in order only with ``sort``.
        """
        if partition is not None:
            collection = collection.partition(partition)
        rows = self.in_range(self.rows(collection), startkey, endkey, key, keys, inclusive_end, startkey_docid, endkey_docid, descending)
        columns = [c for c in rows.columns if c.startswith("k") and c[1:].isdigit()]
        if self.reduce is not None and reduce is not False:
            n = min(group_level, len(columns)) if group_level else len(columns) if group else 0
            out = reduced(rows, columns[:n], columns, self.reduce)
            columns = columns[:n]
            ordering = columns
        else:
            out = with_docs(rows, collection.docs) if include_docs and limit is None else rows
            ordering = [*columns, "id"]
        order = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in ordering]
        if order and (limit is not None or skip or sort):
            out = out.orderBy(*order)
        out = out.offset(skip) if skip else out
        out = out.limit(limit) if limit is not None else out
        if include_docs and limit is not None and "id" in out.columns:
            out = with_docs(out, collection.docs).orderBy(*order)  # a page is small; the join lost its order
        return out

    def metadata(self, collection: Collection, *, startkey=None, endkey=None, key=None, inclusive_end: bool = True, descending: bool = False, skip: int = 0) -> DataFrame:
        """``total_rows, offset, update_seq`` of a query without reduction: rows of the whole view, rows before the first one returned, and the last sequence number. One pass."""
        start = key if key is not None else startkey
        docs = collection.docs
        seq = docs.agg(F.max("_seq")).first()[0] if "_seq" in docs.columns else None
        rows = self.rows(collection)
        if start is None:
            before = F.lit(False)
        else:
            names = [c for c in rows.columns if c.startswith("k") and c[1:].isdigit()]
            before = ~compare([F.col(c) for c in names], [rows.schema[c].dataType for c in names], _bound(start), True, less=descending)
        return rows.agg(F.count(F.lit(1)).alias("total_rows"), F.least(F.count_if(before) + skip, F.count(F.lit(1))).alias("offset")).withColumn("update_seq", F.lit(seq).cast("long"))

    @staticmethod
    def in_range(rows: DataFrame, startkey, endkey, key, keys, inclusive_end, startkey_docid, endkey_docid, descending) -> DataFrame:
        names = [c for c in rows.columns if c.startswith("k") and c[1:].isdigit()]
        columns, types = [F.col(c) for c in names], [rows.schema[c].dataType for c in names]
        if keys is not None:  # ranges do not count beside keys
            return rows.where(key_in(columns, types, [_bound(k) for k in keys]))
        if key is not None:
            startkey = endkey = key
        low, high = (endkey, startkey) if descending else (startkey, endkey)
        low_id, high_id = (endkey_docid, startkey_docid) if descending else (startkey_docid, endkey_docid)
        if low is not None:
            rows = rows.where(compare(columns, types, _bound(low), inclusive_end or not descending, less=False))
        if high is not None:
            rows = rows.where(compare(columns, types, _bound(high), inclusive_end or descending, less=True))
        if low_id is not None:
            rows = rows.where(F.col("id") >= low_id)
        if high_id is not None:
            rows = rows.where(F.col("id") <= high_id)
        return rows

    def queries(self, collection: Collection, options: Sequence[dict]) -> list[DataFrame]:
        return [self.query(collection, **o) for o in options]

    def by_keys(self, collection: Collection, keys: DataFrame, key_col: str = "key") -> DataFrame:
        """Rows whose single key stands in a table of keys; a join, for lists too long for a condition. Repeated keys repeat rows."""
        rows = self.rows(collection)
        return rows.join(keys.select(F.col(key_col).alias("k0")), "k0")


@dataclass
class PythonView(View):
    """A view whose map no column expresses: ``function`` takes a document as a dict and yields (key, value) pairs.

    ``key`` and ``value`` are types; a key type of several fields is ``k0 type, k1 type`` and takes tuples. Documents for which the
    function fails emit nothing; ``failures``, an accumulator, counts them. Only ``columns`` of the documents are sent to Python, in Arrow batches.
    """

    emits: Sequence[Emit] = ()
    function: Callable[[dict], object] | None = None
    key: str = "k0 string"
    value: str = "string"
    columns: Sequence[str] = ()
    failures: Accumulator | None = None

    def rows(self, collection: Collection) -> DataFrame:
        import pandas as pd

        docs = collection.live().docs.select("_id", *self.columns)
        function, n, failures = self.function, len(self.key.split(",")), self.failures
        names = ["id", *[f"k{i}" for i in range(n)], "value"]

        def run(frames):
            for frame in frames:
                out = []
                for doc in frame.to_dict("records"):
                    try:
                        pairs = list(function(doc))
                    except Exception:  # the document is not the view's
                        if failures is not None:
                            failures.add(1)
                        continue
                    out.extend((doc["_id"], *(k if n > 1 else (k,)), v) for k, v in pairs)
                yield pd.DataFrame(out, columns=names)

        return docs.mapInPandas(run, f"id string, {self.key}, value {self.value}")


def _bound(v):
    return None if v == (None,) else v


@dataclass
class GroupedReduce:
    """A reduction by a function that no aggregate expresses.

    ``partial`` takes a pandas DataFrame of (key columns, value) batches and returns partial values by key, ``final`` those of
    one key: associative ones are reduced within tasks first. Without ``partial`` a key's rows meet in one call of ``final``, in one
    task's memory, which ``gathers=True`` must allow: it is for keys of bounded size, never for the whole table.
    """

    final: Callable
    schema: str
    partial: Callable | None = None
    partial_schema: str | None = None
    gathers: bool = False


def reduced(rows: DataFrame, group: list[str], columns: list[str], how: str | GroupedReduce) -> DataFrame:
    """Groups by the first key columns; without any, one group that exists only if a row does."""
    if isinstance(how, GroupedReduce):
        return _grouped(rows, group, how)
    kind = rows.schema["value"].dataType
    by = rows.groupBy(*group) if group else rows.groupBy(F.lit(0).alias("_all"))
    match how:
        case "_count":
            out = by.agg(F.count(F.lit(1)).alias("value"))
        case "_sum" if isinstance(kind, T.ArrayType):
            return sum_arrays(rows, group)
        case "_sum":
            number = F.col("value") if isinstance(kind, T.NumericType) else F.col("value").try_cast("double")
            out = by.agg(F.coalesce(F.sum(number), F.lit(0)).alias("value"))
        case "_stats":
            v = F.col("value").cast("double")
            out = by.agg(F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(F.lit(1)).alias("count"), F.sum(v * v).alias("sumsqr"))
        case "_approx_count_distinct":
            key = F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)
            out = by.agg(F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(key), 11)).alias("value"))
        case _:
            raise ValueError(f"unknown reducer {how}")
    return out if group else out.drop("_all")


def sum_arrays(rows: DataFrame, group: list[str]) -> DataFrame:
    """Element-wise sums, shorter arrays padded with 0; two partial aggregations and no gathered rows."""
    at = rows.select(*group, F.posexplode("value").alias("pos", "x")).groupBy(*group, "pos").agg(F.sum("x").alias("s"))
    by = at.groupBy(*group) if group else at.groupBy(F.lit(0).alias("_all"))
    out = by.agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("s", F.lit(0)).alias("s")))).alias("a"))  # as many as the longest array has
    return out.select(*group, F.col("a.s").alias("value"))


def _grouped(rows: DataFrame, group: list[str], how: GroupedReduce) -> DataFrame:
    if how.partial is None and not (how.gathers and group):
        raise ValueError("a reduction without a partial step gathers its groups; allow it by gathers=True and group by a key")
    keyed = rows if group else rows.withColumn("_all", F.lit(0))
    by = group or ["_all"]
    if how.partial is not None:
        fields = ", ".join(f"{c} {keyed.schema[c].dataType.simpleString()}" for c in by)
        partial = how.partial

        def run(frames):
            for frame in frames:
                if len(frame):
                    yield partial(frame, by)

        keyed = keyed.mapInPandas(run, f"{fields}, {how.partial_schema}")
    out = keyed.groupBy(*by).applyInPandas(how.final, ", ".join([*[f"{c} {keyed.schema[c].dataType.simpleString()}" for c in by], how.schema]))
    return out if group else out.drop("_all")


def all_levels(view: View, collection: Collection) -> DataFrame:
    """Counts of every group level at once, by ROLLUP: an extension of ``group_level``."""
    rows = view.rows(collection)
    columns = [c for c in rows.columns if c.startswith("k") and c[1:].isdigit()]
    return rows.rollup(*columns).agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("value"))
