"""Full-text search over collections.

Queries are built from ``Term``, ``Phrase``, ``Wildcard``, ``NumberRange`` and ``Everything`` with ``&``, ``|`` and ``~``, and compile to conditions
over analysed token arrays, so a search is a scan with a filter. With postings that ``write_postings`` stored, sorted by field and
term, the same queries read the postings of their words alone and join the documents by id; small tables need none.
Facets, drill-down, groups and highlights are ordinary aggregations.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import analyse, folded, highlight, tokens, whole_words, wildcard_pattern
from .collection import Collection

DEFAULT_LIMIT, FACET_TERMS = 25, 1000


def _is(word: str):
    return lambda t: t == word


def _posting(field: str):
    return lambda t, k: F.struct(F.lit(field).alias("field"), t.alias("term"), k.alias("pos"))


class Query:
    def __and__(self, other: Query) -> Query:
        return Both(self, other)

    def __or__(self, other: Query) -> Query:
        return Either(self, other)

    def __invert__(self) -> Query:
        return Without(self)

    def condition(self, index: SearchIndex) -> Column:
        raise NotImplementedError

    def ids(self, index: SearchIndex) -> DataFrame:
        """``id`` of the documents that match, each once, from postings; conditions that no word decides are looked up in the documents."""
        return index.collection.live().docs.where(self.condition(index)).select(F.col(index.id_col).alias("id")).distinct()

    def words(self) -> list[tuple[str | None, str]]:
        """(field, word) that count for rank and highlights."""
        return []


@dataclass
class Everything(Query):
    def condition(self, index: SearchIndex) -> Column:
        return F.lit(True)


@dataclass
class Term(Query):
    """Any of the analysed words of ``text``, in a field or in all text fields together."""

    text: str
    field: str | None = None

    def condition(self, index: SearchIndex) -> Column:
        found = list(dict.fromkeys(analyse(self.text)))
        if not found:
            return F.lit(False)
        # whole words need looking for only where their letters stand at all
        return reduce(or_, [index.has_letters(self.field, w) for w in found]) & reduce(or_, [folded(c).rlike(whole_words(found)) for c in index.text_columns(self.field)])

    def ids(self, index: SearchIndex) -> DataFrame:
        return index.posted(self.field).where(F.col("term").isin(analyse(self.text))).select("id").distinct()

    def words(self) -> list[tuple[str | None, str]]:
        return [(self.field, w) for w in analyse(self.text)]


@dataclass
class Phrase(Query):
    """The analysed words next to each other, in order."""

    text: str
    field: str | None = None

    def condition(self, index: SearchIndex) -> Column:
        found = analyse(self.text)
        if not found:
            return F.lit(False)
        joined = [F.concat(F.lit(" "), F.array_join(tokens(c), " "), F.lit(" ")) for c in index.text_columns(self.field)]  # a phrase stands in one field
        return reduce(and_, [index.has_letters(self.field, w) for w in found]) & reduce(or_, [j.contains(f" {' '.join(found)} ") for j in joined])

    def ids(self, index: SearchIndex) -> DataFrame:
        """Each posting votes for the places where the phrase would begin; a place with all votes is one."""
        found = analyse(self.text)
        places = reduce(DataFrame.unionByName, [index.posted(self.field).where(F.col("term") == w).select("id", "field", (F.col("pos") - k).alias("at")) for k, w in enumerate(found)] or [index.posted(self.field).where("false").select("id", "field", F.lit(0).alias("at"))])
        return places.groupBy("id", "field", "at").agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") == len(found)).select("id").distinct()

    def words(self) -> list[tuple[str | None, str]]:
        return [(self.field, w) for w in analyse(self.text)]


@dataclass
class Wildcard(Query):
    """A token that fits ``*`` (any characters) and ``?`` (one); the pattern itself is not analysed."""

    pattern: str
    field: str | None = None

    def condition(self, index: SearchIndex) -> Column:
        return F.exists(index.tokens(self.field), lambda t: t.rlike(wildcard_pattern(self.pattern)))

    def ids(self, index: SearchIndex) -> DataFrame:
        start = re.match(r"[^*?]*", self.pattern)[0]  # the letters before the first wildcard narrow the range of terms that is read
        return index.posted(self.field).where(F.col("term").startswith(start) & F.col("term").rlike(wildcard_pattern(self.pattern))).select("id").distinct()


@dataclass
class NumberRange(Query):
    field: str
    low: float | None = None
    high: float | None = None

    def condition(self, index: SearchIndex) -> Column:
        c = index.fields[self.field].column
        low = F.lit(True) if self.low is None else c >= self.low
        return F.coalesce(low & (F.lit(True) if self.high is None else c < self.high), F.lit(False))


@dataclass
class Both(Query):
    a: Query
    b: Query

    def condition(self, index: SearchIndex) -> Column:
        return self.a.condition(index) & self.b.condition(index)

    def ids(self, index: SearchIndex) -> DataFrame:
        return self.a.ids(index).join(self.b.ids(index), "id", "left_semi")

    def words(self):
        return self.a.words() + self.b.words()


@dataclass
class Either(Query):
    a: Query
    b: Query

    def condition(self, index: SearchIndex) -> Column:
        return self.a.condition(index) | self.b.condition(index)

    def ids(self, index: SearchIndex) -> DataFrame:
        return self.a.ids(index).unionByName(self.b.ids(index)).distinct()

    def words(self):
        return self.a.words() + self.b.words()


@dataclass
class Without(Query):
    a: Query

    def condition(self, index: SearchIndex) -> Column:
        return ~F.coalesce(self.a.condition(index), F.lit(False))

    def ids(self, index: SearchIndex) -> DataFrame:
        return Everything().ids(index).join(self.a.ids(index), "id", "left_anti")


@dataclass
class IndexField:
    column: Column
    kind: str = "text"  # text, number or boolean
    store: bool = False
    facet: bool = False


@dataclass
class SearchIndex:
    """What a search sees of each document. ``id_col`` breaks ties and names hits."""

    collection: Collection
    fields: dict[str, IndexField]
    id_col: str = "_id"
    stored: DataFrame | None = None  # postings as ``write_postings`` wrote them

    def posted(self, field: str | None) -> DataFrame:
        """Stored postings of one field or of all; the condition on the field reaches the scan."""
        return self.stored if field is None else self.stored.where(F.col("field") == field)

    def text_columns(self, field: str | None) -> list[Column]:
        return [self.fields[field].column] if field is not None else [f.column for f in self.fields.values() if f.kind == "text"]

    def tokens(self, field: str | None) -> Column:
        parts = [tokens(c) for c in self.text_columns(field)]
        return parts[0] if len(parts) == 1 else F.flatten(F.array(*parts))

    def has_letters(self, field: str | None, word: str) -> Column:
        return reduce(or_, [folded(c).contains(word) for c in self.text_columns(field)])

    def hits(self, query: Query, drilldown: Sequence[tuple[str, Sequence[str]]] = ()) -> DataFrame:
        """Documents that match; each drill-down keeps those whose field has one of its values."""
        docs = self.collection.live().docs
        docs = docs.where(query.condition(self)) if self.stored is None else docs.join(query.ids(self).withColumnRenamed("id", "_hit"), F.col(self.id_col) == F.col("_hit"), "left_semi")
        for name, values in drilldown:
            docs = docs.where(self.fields[name].column.cast("string").isin(list(values)))
        return docs

    def scored(self, query: Query, hits: DataFrame) -> DataFrame:
        """Hits with ``score`` (BM25 over the query's words; only its order means anything)."""
        words = list(dict.fromkeys(query.words()))
        if not words:
            return hits.withColumn("score", F.lit(1.0))
        fields = list(dict.fromkeys(f for f, _ in words))
        name = {f: f"_tokens{k}" for k, f in enumerate(fields)}  # analysed once a field
        docs = self.collection.live().docs.select(*[self.tokens(f).alias(name[f]) for f in fields])
        has = [F.count_if(F.array_contains(name[f], w)).alias(f"n{k}") for k, (f, w) in enumerate(words)]
        sizes = [F.avg(F.size(name[f])).alias(f"s{k}") for k, (f, _) in enumerate(words)]
        total = docs.agg(F.count(F.lit(1)).alias("n"), *has, *sizes).first()  # one row, two figures a word
        parts = []
        for k, (f, w) in enumerate(words):
            idf = math.log(1 + (total["n"] - total[f"n{k}"] + 0.5) / (total[f"n{k}"] + 0.5))
            tf = F.size(F.filter(name[f], _is(w)))
            parts.append(F.lit(idf) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * F.size(name[f]) / F.lit(max(total[f"s{k}"] or 1.0, 1e-9)))))
        return hits.withColumns({name[f]: self.tokens(f) for f in fields}).withColumn("score", sum(parts[1:], parts[0])).drop(*name.values())

    def _order(self, sort: Sequence[str]) -> list[Column]:
        found = []
        for s in sort:
            c = self.fields[s.lstrip("-")].column
            found.append(c.desc_nulls_last() if s.startswith("-") else c.asc_nulls_first())
        return [*(found or [F.col("score").desc()]), F.col(self.id_col)]

    def search(self, query: Query, *, sort: Sequence[str] = (), limit: int = DEFAULT_LIMIT, bookmark: int = 0, drilldown: Sequence = (), include_fields: Sequence[str] | None = None, highlight_fields: Sequence[str] = (), include_docs: bool = False) -> DataFrame:
        """A page of hits: the id, stored fields, highlights and, if asked for, the document. ``bookmark``: rows to skip."""
        hits = self.hits(query, drilldown)
        rows = hits if sort else self.scored(query, hits)
        rows = rows.orderBy(*self._order(sort))
        rows = (rows.offset(bookmark) if bookmark else rows).limit(limit)
        stored = [n for n, f in self.fields.items() if f.store and (include_fields is None or n in include_fields)]
        words = [w for _, w in query.words()]
        marks = [highlight(self.fields[n].column, words).alias(f"highlight_{n}") for n in highlight_fields]
        doc = [F.struct(*[F.col(f"`{c}`") for c in self.collection.docs.columns]).alias("doc")] if include_docs else []
        return rows.select(F.col(self.id_col), *[self.fields[n].column.alias(n) for n in stored], *marks, *doc)

    def total(self, query: Query, drilldown: Sequence = ()) -> DataFrame:
        return self.hits(query, drilldown).agg(F.count(F.lit(1)).alias("total_rows"))

    def counts(self, query: Query, facets: Sequence[str], drilldown: Sequence = ()) -> DataFrame:
        """``field, term, n``: the most frequent terms of each facet, 1,000 at most."""
        hits = self.hits(query, drilldown)
        pairs = F.array(*[F.struct(F.lit(n).alias("field"), self.fields[n].column.cast("string").alias("term")) for n in facets])
        found = hits.select(F.explode(pairs).alias("p")).select("p.*").where("term IS NOT NULL").groupBy("field", "term").agg(F.count(F.lit(1)).alias("n"))
        place = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "term"))
        return found.withColumn("place", place).where(F.col("place") <= FACET_TERMS).drop("place")

    def ranges(self, query: Query, ranges: dict[str, dict[str, tuple[float | None, float | None]]], drilldown: Sequence = ()) -> DataFrame:
        """``field, label, n`` of labelled number ranges, low end included, high end not. One pass."""
        named = [(n, label, NumberRange(n, *bounds)) for n, labels in ranges.items() for label, bounds in labels.items()]
        one = self.hits(query, drilldown).agg(*[F.count_if(q.condition(self)).alias(f"n{k}") for k, (_, _, q) in enumerate(named)])
        rows = F.array(*[F.struct(F.lit(n).alias("field"), F.lit(label).alias("label"), F.col(f"n{k}").alias("n")) for k, (n, label, _) in enumerate(named)])
        return one.select(F.explode(rows).alias("r")).select("r.*")

    def groups(self, query: Query, field: str, *, group_limit: int = 1, sort: Sequence[str] = (), drilldown: Sequence = ()) -> DataFrame:
        """The first hits of each value of a field, with their place and the value's ``total_rows``."""
        hits = self.hits(query, drilldown)
        rows = hits if sort else self.scored(query, hits)
        by = self.fields[field].column
        rows = rows.withColumn("group", by)
        totals = rows.groupBy("group").agg(F.count(F.lit(1)).alias("total_rows"))
        place = F.row_number().over(Window.partitionBy("group").orderBy(*self._order(sort)))
        first = rows.withColumn("place", place).where(F.col("place") <= group_limit)  # Spark keeps the first k of each task before the shuffle
        return first.join(totals, "group").select("group", "total_rows", "place", self.id_col)

    def postings(self) -> DataFrame:
        """``field, term, id, pos`` of all text fields: a row per word, in one pass and without a shuffle."""
        parts = [F.transform(tokens(f.column), _posting(n)) for n, f in self.fields.items() if f.kind == "text"]
        docs = self.collection.live().docs.select(F.col(self.id_col).alias("id"), F.explode(F.concat(*parts)).alias("p"))
        return docs.select("p.field", "p.term", "id", "p.pos")

    def write_postings(self, path: str) -> SearchIndex:
        """Store postings sorted by field and term, so that a search reads the row groups of its words alone, and search by them from then on."""
        rows = self.postings().repartitionByRange("field", "term", "id").sortWithinPartitions("field", "term", "id", "pos")
        rows.write.mode("overwrite").parquet(path)
        return replace(self, stored=rows.sparkSession.read.schema(rows.schema).parquet(path))
