"""Each stage of the pipeline against brute force on its own input."""

import hashlib
from collections import Counter

import pytest

import corpus_pipeline as p

from .helpers import near_duplicate_components, words
from .test_operators import brute_hits, plain_targets


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output rows of each stage, by name."""
    sf = "/root/testdata/sf0.001"
    docs, found = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in p.STAGES:
        out = p.spill(stage(spark, docs, sf), name)
        found[name] = (docs.collect(), out.collect())
        docs = out
    return found


def rows(docs):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs]


def test_columns(spark, steps):
    columns = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").columns
    assert all(list(out[0].asDict()) == columns for name, (_, out) in steps.items() if name != "mixing")


def test_language_keeps_texts_of_a_language(steps):
    before, after = steps["language_id"]
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert len(gone) <= 0.01 * len(before)
    assert all(len(r["text"]) < 100 for r in before if r["doc_id"] in gone)


def without_spread_lines(before):
    """Texts by id without lines on four sources or more, but for each line's longest text."""
    sites, longest = {}, {}
    rank = lambda text: (len(text), hashlib.md5(text.encode()).digest())
    for r in before:
        for line in r["text"].split("\n"):
            line = line.strip(" ")
            sites.setdefault(line, set()).add(r["source"])
            longest[line] = max(longest.get(line, r["text"]), r["text"], key=rank)
    stays = lambda x, text: len(x) < 15 or len(sites[x]) < 4 or longest[x] == text
    return {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if stays(x.strip(" "), r["text"])) for r in before}


def test_lines_on_four_sources_go(steps):
    before, after = steps["line_dedup"]
    want = without_spread_lines(before)
    assert {r["doc_id"]: r["text"] for r in after} == want
    assert sum(r["text"] != want[r["doc_id"]] for r in before) > 0.1 * len(before)
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_one_of_many_near_copies_stays_whole(spark):
    said = [f"The {k}th sentence of a story that each paper prints in its own way." for k in range(40)]
    rows = [(k, "\n".join([*said[:k], f"Edited by paper {k} for length and style" + "!" * (k == 5), *said[k + 1 :], "Subscribe to our letter today"]), "en", f"s{k}", 0) for k in range(8)]
    rows += [(100 + k, f"Subscribe to our letter today\nPaper {k} on gardens", "en", f"s{k}", 0) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    after = {r["doc_id"]: r["text"] for r in p.line_dedup(spark, docs, "").collect()}
    assert after == without_spread_lines([r.asDict() for r in docs.collect()])
    assert after[5] == rows[5][1] and all(after[100 + k] == f"Paper {k} on gardens" for k in range(8))
    assert sum(len(after[k]) for k in range(8) if k != 5) < len(after[5])


def test_one_of_each_component_stays(steps):
    before, after = steps["near_dedup"]
    want = near_duplicate_components(rows(before), 5, 80)
    assert {r["doc_id"] for r in after} == {i for i, (_, c) in want.items() if i == c}


def test_contaminated_documents_go(spark, steps):
    before, after = steps["decontaminate"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    bad = {i for i, n, hit, _ in brute_hits(rows(before), items) if hit and 20 * hit >= n}
    assert bad and {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - bad
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_mix_meets_its_targets(steps):
    before, after = steps["mixing"]
    sizes = Counter()
    for r in before:
        sizes[r["source"]] += len(words(r["text"]))
    want, taken = plain_targets(sizes), Counter()
    for r in after:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_run(spark):
    assert p.run(spark, "/root/testdata/sf0.001").count() > 0


def test_one_copy_of_a_text_on_many_sources_stays(spark):
    said = [f"The {k}th sentence of a story that was reprinted in many papers." for k in range(40)]
    rows = [(k, "\n".join(said), "en", f"s{k % 5}", 0) for k in range(10)]
    rows += [(100 + k, f"All rights are reserved by us.\nPaper number {k} says something else of its own", "en", f"s{k}", 0) for k in range(4)]
    rows += [(200, said[0] + "\nand a quotation of the story.", "en", "s9", 0), (201, None, "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    after = {r["doc_id"]: r["text"] for r in p.line_dedup(spark, docs, "").collect()}
    assert all(after[k] == "\n".join(said) for k in range(10))
    whole = [k for k in range(4) if after[100 + k] == rows[10 + k][1]]
    assert len(whole) == 1 and all(after[100 + k] == f"Paper number {k} says something else of its own" for k in range(4) if k not in whole)
    assert after[200] == rows[-2][1] and after[201] is None
    kept = p.near_dedup(spark, p.spill(p.line_dedup(spark, docs, ""), "lines"), "").collect()
    assert [r["doc_id"] for r in kept if r["text"] == "\n".join(said)] == [0]
