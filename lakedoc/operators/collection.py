"""A collection of documents: a DataFrame with an ``_id`` and typed columns or a VARIANT body.

Columns with a meaning: ``_id`` string; ``_rev`` string; ``_deleted`` boolean; ``_seq`` long. Others are the body.
All results are lazy DataFrames, so filters, columns and limits reach the scan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.collation import mixed_key
from ..functions.fields import Fields, Typed
from ..functions.selector import equality_conditions, matches

META = ("_id", "_rev", "_deleted", "_seq", "_rev_history", "_attachments")
DEFAULT_FIND_LIMIT = 25


@dataclass
class Collection:
    """``order``: columns that break ties and page through results, ``_id`` by default."""

    docs: DataFrame
    body: str | None = None
    order: Sequence[str] = ("_id",)
    local: DataFrame | None = None
    indexes: list = field(default_factory=list)
    prefix: str | None = None  # of all ids, where they are made of a prefix and the columns in ``order``
    parts: dict = field(default_factory=dict)  # collections by prefix, of which this one is the union

    @classmethod
    def from_table(cls, df: DataFrame, prefix: str, keys: Sequence[str]) -> Collection:
        """Rows of a table as documents ``prefix:key:...``; the prefix is also their partition.

        Conditions on ids are also put on the key columns, so they reach the scan where keys are whole numbers.
        """
        return cls(df.withColumn("_id", F.concat_ws(":", F.lit(prefix), *[F.col(k).cast("string") for k in keys])), order=tuple(keys), prefix=prefix)

    @classmethod
    def of_parts(cls, parts: Sequence[Collection]) -> Collection:
        """The union of collections with prefixes; a partition of it is read from its own part alone."""
        return cls(reduce(DataFrame.unionByName, [p.docs for p in parts]), parts={p.prefix: p for p in parts})

    @classmethod
    def from_json(cls, df: DataFrame, text_col: str, id_col: Column) -> Collection:
        """Rows whose text is a JSON document; malformed ones have a null body."""
        return cls(df.select(id_col.cast("string").alias("_id"), F.try_parse_json(F.col(text_col)).alias("body")), body="body")

    @property
    def fields(self) -> Fields:
        return Fields(self.docs, self.body)

    def live(self) -> Collection:
        """Without tombstones, design documents and local documents."""
        docs = self.docs
        if "_deleted" in docs.columns:
            docs = docs.where(~F.coalesce("_deleted", F.lit(False)))
        if tuple(self.order) == ("_id",):
            docs = docs.where(~F.col("_id").startswith("_design/") & ~F.col("_id").startswith("_local/"))
        return replace(self, docs=docs)

    def where(self, selector: dict) -> Collection:
        return replace(self, docs=self.docs.where(matches(selector, self.fields)))

    # -- declarative find ------------------------------------------------------------

    def sort_columns(self, sort: Sequence) -> list[Column]:
        """``["a", {"b": "desc"}]`` as orderings: nulls first, mixed kinds in collation order, ties by id."""
        found = []
        for item in sort:
            name, direction = next(iter(item.items())) if isinstance(item, dict) else (item, "asc")
            if direction not in ("asc", "desc"):
                raise ValueError(f"sort direction {direction}")
            f = self.fields(name)
            c = f.column if isinstance(f, Typed) else mixed_key(f.value)
            found.append(c.asc_nulls_first() if direction == "asc" else c.desc_nulls_last())
        return found

    def find(self, selector: dict, *, fields: Sequence[str] | None = None, sort: Sequence = (), limit: int | None = DEFAULT_FIND_LIMIT, skip: int = 0, bookmark=None, partition: str | None = None, stats: Observation | None = None) -> DataFrame:
        """Documents that match, sorted, paged and projected. ``bookmark``: the last row's order value; rows after it follow.

        ``limit=None`` returns all; 0 stands for the default, 25. ``stats`` observes ``docs_examined``, which keeps the filter out of the scan.
        """
        found = self.live()
        if stats is not None:
            found = replace(found, docs=found.docs.observe(stats, F.count(F.lit(1)).alias("docs_examined")))
        if partition is not None:
            found = found.partition(partition)
        found = found.where(selector)
        docs = found.docs
        if bookmark is not None:
            if sort:
                raise ValueError("a bookmark pages in order of ids")
            after = bookmark if isinstance(bookmark, (list, tuple)) else [bookmark]
            pairs = list(zip(self.order, after, strict=True))
            past = [reduce(and_, [F.col(c) == v for c, v in pairs[:k]], F.col(pairs[k][0]) > pairs[k][1]) for k in range(len(pairs))]
            docs = docs.where(reduce(or_, past))
        ordering = [*self.sort_columns(sort), *self.order]
        if limit is not None:
            docs = docs.orderBy(*ordering)
            docs = docs.offset(skip).limit(limit or DEFAULT_FIND_LIMIT) if skip else docs.limit(limit or DEFAULT_FIND_LIMIT)
        elif sort:
            docs = docs.orderBy(*ordering)
        return project(docs, fields, self.body) if fields else docs

    def explain(self, selector: dict, **options) -> dict:
        """The chosen index (the first whose fields all have an equality, else all documents) and Catalyst's plan."""
        bound = set(equality_conditions(selector))
        index = next((i for i in self.indexes if set(i["fields"]) <= bound), None) if not options.get("sort") else None
        plan = self.find(selector, **options)
        return {"index": index or {"ddoc": None, "name": "_all_docs", "type": "special", "fields": ["_id"]}, "selector": selector, "limit": options.get("limit", DEFAULT_FIND_LIMIT), "skip": options.get("skip", 0), "fields": options.get("fields") or "all_fields", "plan": plan._jdf.queryExecution().toString()}

    # -- ids ----------------------------------------------------------------------------

    def get(self, doc_id: str) -> DataFrame:
        return self._with_id(doc_id)

    def _whole_keys(self) -> bool:
        return self.prefix is not None and all(isinstance(self.docs.schema[k].dataType, T.IntegralType) for k in self.order)

    def _with_id(self, doc_id: str) -> DataFrame:
        """Documents of one id; whole-number keys are read off it."""
        docs = self.docs.where(F.col("_id") == doc_id)
        found = doc_id.split(":")[-len(self.order) :]
        if self._whole_keys() and doc_id == ":".join([self.prefix, *found]) and all(re.fullmatch(r"-?\d{1,18}", v) for v in found):
            for k, v in zip(self.order, found, strict=True):
                docs = docs.where(F.col(k) == int(v))
        return docs

    def _between_ids(self, low: str | None, high: str | None) -> Column | None:
        """What a range of ids says of a single whole-number key: for each number of digits, a range of numbers. None: nothing."""
        if not self._whole_keys() or len(self.order) > 1:
            return None
        most = 18 if isinstance(self.docs.schema[self.order[0]].dataType, T.LongType) else 9
        digits = lambda bound: re.match(r"\d*", bound[len(self.prefix) + 1 :])[0] if bound is not None and bound.startswith(f"{self.prefix}:") else ""
        a, b = digits(low), digits(high)
        if not a and not b:
            return None
        key = F.col(self.order[0])
        ranges = [(int(a[:n].ljust(n, "0")), int(b[:n].ljust(n, "9"))) for n in range(1, most + 1)]
        return reduce(or_, [(key >= x) & (key <= y) for x, y in ranges if x <= y], (key < 0) | (key >= 10**most))

    def all_docs(self, *, startkey=None, endkey=None, key=None, inclusive_end: bool = True, descending: bool = False, skip: int = 0, limit: int | None = None, include_docs: bool = False, prefix: str | None = None) -> DataFrame:
        """``id, key, rev`` (and ``doc``) by id range. ``descending`` reverses the order and the roles of the bounds."""
        docs = self.live().docs if prefix is None else self.docs.where(F.col("_id").startswith(prefix))
        if key is not None:
            docs = replace(self, docs=docs)._with_id(key)
        low, high = (endkey, startkey) if descending else (startkey, endkey)
        at = F.col("_id")
        if (bounds := self._between_ids(low, high)) is not None:
            docs = docs.where(bounds)
        if low is not None:
            docs = docs.where(at >= low if inclusive_end or not descending else at > low)
        if high is not None:
            docs = docs.where(at <= high if inclusive_end or descending else at < high)
        rows = docs.select(*_id_row(docs, include_docs))
        if skip or limit is not None:
            rows = rows.orderBy(F.col("id").desc() if descending else F.col("id").asc())
            rows = rows.offset(skip) if skip else rows
            rows = rows.limit(limit) if limit is not None else rows
        return rows

    def all_docs_by_keys(self, keys: DataFrame, key_col: str = "key", include_docs: bool = False) -> DataFrame:
        """A row per requested key, in order of ``pos``: missing ones have the error ``not_found``, tombstones are ``deleted`` and have no document."""
        gone = F.coalesce("_deleted", F.lit(False)) if "_deleted" in self.docs.columns else F.lit(False)
        rows = self.docs.select(*_id_row(self.docs, include_docs), gone.alias("deleted")).drop("key")
        if include_docs:
            rows = rows.withColumn("doc", F.when(~F.col("deleted"), F.col("doc")))
        joined = keys.select("pos", F.col(key_col).alias("key")).join(rows, F.col("key") == F.col("id"), "left")
        return joined.withColumn("error", F.when(F.col("id").isNull(), "not_found"))

    def design_docs(self, **options) -> DataFrame:
        return self.all_docs(prefix="_design/", **options)

    def local_docs(self, **options) -> DataFrame:
        source = self.local if self.local is not None else self.docs.where(F.col("_id").startswith("_local/"))
        return replace(self, docs=source).all_docs(prefix="_local/", **options)

    def queries(self, options: Sequence[dict]) -> list[DataFrame]:
        """Several id-range queries at once; each is a lazy plan of its own."""
        return [self.all_docs(**o) for o in options]

    def bulk_get(self, ids: DataFrame, id_col: str = "id") -> DataFrame:
        """``id, ok, error`` per requested id."""
        docs = self.live().docs
        held = docs.select(F.col("_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("ok"))
        return ids.select(F.col(id_col).alias("id")).join(held, F.col("id") == F.col("_id"), "left").select("id", "ok", F.when(F.col("_id").isNull(), "not_found").alias("error"))

    # -- partitions and figures --------------------------------------------------------

    def partition(self, name: str) -> Collection:
        if self.parts:
            empty = replace(self, docs=self.docs.where(F.lit(False)), parts={})
            return replace(self.parts[name], docs=self.parts[name].docs.select(*self.docs.columns), order=self.order, prefix=None) if name in self.parts else empty
        if self.prefix is not None:  # all documents are of one partition
            return self if name == self.prefix else replace(self, docs=self.docs.where(F.lit(False)))
        return replace(self, docs=self.docs.where(F.col("_id").startswith(f"{name}:")))

    def partition_info(self, name: str) -> DataFrame:
        return self.partition(name).live().docs.agg(F.count(F.lit(1)).alias("doc_count")).select(F.lit(name).alias("partition"), "doc_count", F.lit(0).cast("long").alias("doc_del_count"))

    def info(self) -> DataFrame:
        gone = F.coalesce(F.col("_deleted"), F.lit(False)) if "_deleted" in self.docs.columns else F.lit(False)
        seq = F.max("_seq") if "_seq" in self.docs.columns else F.lit(None).cast("long")
        return self.docs.where(~F.col("_id").startswith("_local/")).agg(F.count_if(~gone).alias("doc_count"), F.count_if(gone).alias("doc_del_count"), seq.alias("update_seq"))


def _id_row(docs: DataFrame, include_docs: bool) -> list[Column]:
    rev = F.col("_rev") if "_rev" in docs.columns else F.lit(None).cast("string")
    row = [F.col("_id").alias("id"), F.col("_id").alias("key"), rev.alias("rev")]
    return [*row, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if include_docs else row


def project(docs: DataFrame, paths: Sequence[str], body: str | None = None) -> DataFrame:
    """``_id``, ``_rev`` and the given paths; a dotted path becomes nested structs again, a missing field null."""
    fields = Fields(docs, body)
    tree: dict = {}
    for p in paths:
        node = tree
        *heads, last = p.split(".")
        for h in heads:
            node = node.setdefault(h, {})
            if not isinstance(node, dict):
                break
        else:
            node[last] = p

    def build(node) -> Column:
        if isinstance(node, str):
            f = fields(node)
            return f.column if not isinstance(f, Typed) or not isinstance(f.type, T.NullType) else F.lit(None).cast("string")
        return F.struct(*[build(v).alias(k) for k, v in node.items()])

    meta = [F.col(c) for c in ("_id", "_rev") if c in docs.columns]
    return docs.select(*meta, *[build(v).alias(k) for k, v in tree.items() if k not in ("_id", "_rev")])


def with_docs(rows: DataFrame, docs: DataFrame, id_col: str = "id") -> DataFrame:
    """Attach the document with each row's id; missing ones are null. Row order is the caller's to set."""
    held = docs.select(F.col("_id").alias("_doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return rows.join(held, F.col(id_col) == F.col("_doc_id"), "left").drop("_doc_id")
