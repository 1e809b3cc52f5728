"""Clashing names, null and repeated ids, ties, long texts, hot groups: defined results, and none too large for a task."""

import base64
import hashlib
import math
import struct
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from lakedoc.llm import decontaminate, language_id, line_dedup, lm_scoring, media, minhash, mixing, quality_crf, suffix_dedup, warc

from .helpers import HARD, docs, fold, words
from .test_operators import GIF, nkey, png

NAMES = ["_id", "_bad", "_gone", "_kept", "line_key", "n_lines", "lang_pred", "quality", "row", "bucket", "digest", "name", "spans", "number", "whole", "kept", "component", "rep", "first", "range", "before", "id", "doc", "n", "a.b", "`tick"]
ITEMS = [(1, "The cat sat on the mat and looked at the other cat second line here plainly written"), (None, "nothing of the kind stands in any text that is here"), (3, None)]


def clashing(spark, rows=HARD):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in NAMES])


def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").select("*", F.lit(1).alias("row"), F.lit(2).alias("words"))


OPERATORS = {
    "lm": lambda s, d: lm_scoring.score_documents(d),
    "suffix": lambda s, d: suffix_dedup.repeated_spans(d),
    "near": lambda s, d: minhash.near_duplicates(d),
    "identify": lambda s, d: language_id.identify(d, language_id.train(d)),
    "media": lambda s, d: media.store_texts(d),
    "quality": lambda s, d: quality_crf.score(d, quality_crf.train(d, s.createDataFrame([(1, 1), (5, 0)], "doc_id long, quality int"))),
    "decontaminate": lambda s, d: decontaminate.find_spans(d, benchmark(s)),
    "lines": lambda s, d: line_dedup.dedup_lines(d),
    "mix": lambda s, d: mixing.mix(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_any_column_names_and_hard_rows(spark, name):
    plain = docs(spark).select("doc_id", "text", "lang", "source")
    out = OPERATORS[name](spark, clashing(spark))
    same = OPERATORS[name](spark, plain)
    shared = [c for c in same.columns if c in out.columns]
    quoted = [f"`{c}`" for c in shared]
    order = lambda rows: sorted(map(str, rows))
    assert order(out.select(*quoted).collect()) == order(same.select(*quoted).collect())
    assert out.count() == len(HARD)
    assert OPERATORS[name](spark, clashing(spark, [])).count() == 0


STAGES = {n: f for n, f in p.STAGES if n != "mixing"}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns_and_bear_hard_rows(spark, tmp_path, name):
    benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    d = clashing(spark)
    out = STAGES[name](spark, d, str(tmp_path))
    assert out.columns == d.columns
    for r in out.collect():
        assert all(r[c] == f"own {c}" for c in NAMES)
    rows = sorted(((r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()), key=lambda r: (nkey(r[0]), str(r[1])))
    every = sorted(((r[0], r[1]) for r in HARD), key=lambda r: (nkey(r[0]), str(r[1])))
    gone = [r for r in every if r not in rows]
    if name == "decontaminate":
        assert [i for i, _ in gone] == [1]
    elif name == "near_dedup":  # 7 is the first of 7, 8 and twice 9; rows without words stay
        assert sorted(i for i, _ in gone) == [8, 9, 9] and len(rows) == len(HARD) - 3
    elif name == "line_dedup":
        assert rows == every
    else:
        assert all(t is None or not any(map(str.isalpha, t)) for _, t in gone) and len(gone) >= 3
    assert STAGES[name](spark, clashing(spark, []), str(tmp_path)).count() == 0


def test_mixing_stage_bears_hard_rows(spark, tmp_path):
    for rows, n in (([(1, 1), (None, 0), (5, None)], len(HARD)), ([], 0)):
        folder = f"{tmp_path}/{n}"
        spark.createDataFrame(rows, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
        out = p.mixing(spark, clashing(spark, HARD if n else []), folder)
        assert out.columns == ["doc_id", "source", "size", "source_size", "target", "taken"]
        assert (out.count() > 0) == (n > 0)


# -- 1


def test_long_words_need_bounded_memory():
    rng = np.random.default_rng(0)
    word = base64.b64encode(rng.bytes(300_000))
    pieces = lm_scoring.load_pieces()
    codes = lm_scoring._codes([word], len(word) + 1)[0]
    tracemalloc.start()
    alpha = lm_scoring.long_forward(codes, pieces)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert math.isfinite(alpha[-1]) and peak < 80 * len(word) + 60_000_000
    short = codes[:300]
    assert lm_scoring.long_forward(short, pieces)[-1] == pytest.approx(lm_scoring.forward(short[None], pieces)[0][-1, 0])
    assert np.allclose(lm_scoring.long_expected(short, 2.0, pieces), lm_scoring.expected(short[None], np.array([2.0]), pieces))


def test_chunks_do_not_change_a_long_word(monkeypatch):
    pieces = lm_scoring.load_pieces()
    codes = lm_scoring._codes([b"internationalisation" * 20], 401)[0]
    whole, uses = lm_scoring.long_forward(codes, pieces), lm_scoring.long_expected(codes, 1.0, pieces)
    monkeypatch.setattr(lm_scoring, "CHUNK", 37)
    assert np.allclose(whole, lm_scoring.long_forward(codes, pieces)) and np.allclose(uses, lm_scoring.long_expected(codes, 1.0, pieces))


def test_score_is_the_sum_of_lattice_marginals(spark):
    """The whole model by hand: two rounds of expected counts over training words, then each word's marginal."""
    rows = [(i, f"tea and coffee number{i % 3} tea", "en", "a") for i in range(12)] + [(50, None, "en", "a")]
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score_documents(docs(spark, rows)).collect()}
    pieces = lm_scoring.load_pieces()
    taught = [w.encode() for i, t, *_ in rows if fold(i, 10) for w in words(t)]
    ends = sum(1 for i, *_ in rows if fold(i, 10))
    for _ in range(2):
        uses = 0.1 + sum(lm_scoring.expected(lm_scoring._codes([w], len(w) + 1), np.ones(1), pieces) for w in taught)
        total = uses.sum()
        pieces = lm_scoring.Pieces(pieces.hashes, np.log(uses / total), pieces.longest)
    share = math.log(total / (total + ends + 0.1))
    for i, t, *_ in rows:
        want = math.log((ends + 0.1) / (total + ends + 0.1))
        for w in words(t):
            codes = lm_scoring._codes([w.encode()], len(w.encode()) + 1)
            shifted = lm_scoring.Pieces(pieces.hashes, pieces.logp + share, pieces.longest)
            want += lm_scoring.forward(codes, shifted)[0][-1, 0]
        assert got[i] == pytest.approx(want / math.log(10), rel=1e-9)


# -- 2


def test_one_passage_in_very_many_documents(spark):
    rng = np.random.default_rng(5)
    letters = lambda n: bytes(rng.integers(97, 123, n, np.uint8)).decode()
    passage = letters(400)
    rows = [(k, letters(40) + passage + letters(40), "en", "a") for k in range(20_000)]
    out = suffix_dedup.repeated_spans(docs(spark, rows), bucket_bytes=100_000).select("n_bytes", "n_removed", "spans").distinct().collect()
    removed = {r["n_removed"] for r in out}
    assert min(removed) >= 400 and max(removed) <= 410  # some neighbours share a letter of their surroundings


# -- 3


def test_links_are_as_many_as_documents():
    rng = np.random.default_rng(2)
    base = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    near = [np.sort(np.concatenate([base[:-3], rng.integers(0, 2**63, 3).astype(np.uint64)])) for _ in range(200)]
    a, b = minhash.joined(list(range(100)), near[:100], list(zip(range(100, 200), near[100:], strict=True)), 80)
    assert len(a) == 199 and set(b.tolist()) == {0}
    lone = [np.sort(rng.integers(0, 2**63, 300).astype(np.uint64)) for _ in range(5)]
    assert len(minhash.joined([1, 2, 3], lone[:3], [(4, lone[3]), (2, lone[1])], 80)[0]) == 0


def test_string_ids_and_hot_groups(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(f"k{i:04d}", text + f" tail{i % 7}", "en", "a") for i in range(600)] + [("a", "another text of its own", "en", "a"), (None, text + " tail0", "en", "a")]
    d = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")
    got = {r["doc_id"]: (r["component_id"], r["first"]) for r in minhash.near_duplicates(d, width=4, block_bytes=1000).collect()}
    assert got == {**{i: ("k0000", i == "k0000") for i, *_ in rows if i and i != "a"}, "a": ("a", True), None: ("k0000", False)}
    assert sorted(r["doc_id"] for r in minhash.drop_near_duplicates(d).collect()) == ["a", "k0000"]


# -- 4


def test_decoding_by_hand(spark):
    """Counts, weights, bits and losses in plain Python, n-gram by n-gram."""
    rows = [(1, "the cat sat on the mat", "en", "a"), (2, "the dog and the cat", "en", "a"), (3, "der hund und die katze", "de", "a"), (4, "le chat et le chien", "fr", "a")]
    asked = [(10, "the hund", None, "a"), (11, "chat", None, "a"), (12, "x", None, "a"), (13, "1 2", None, "a")]
    model = language_id.train(docs(spark, rows))

    def grams(text):
        block = language_id.Block(np.frombuffer(text.encode(), np.uint8), np.zeros(1, np.int64), np.array([len(text.encode())]), 0)
        return [int(b) for bucket in language_id.ngram_buckets(block) for b in bucket if b < language_id.BUCKETS]

    langs = ["de", "en", "fr"]
    count = {x: {} for x in langs}
    for _, t, lang, _ in rows:
        for g in grams(t):
            count[lang][g] = count[lang].get(g, 0) + 1
    mass = {x: sum(count[x].values()) + 0.5 * language_id.BUCKETS for x in langs}
    share = {x: np.full(language_id.BUCKETS, 0.5) for x in langs}
    for x in langs:
        for g, n in count[x].items():
            share[x][g] += n
        share[x] /= mass[x]
    code = language_id.codewords(3)
    odds, centre, scale = [], [], []
    for b in range(code.shape[1]):
        yes = np.mean([share[x] for x, s in zip(langs, code[:, b], strict=True) if s > 0], 0)
        no = np.mean([share[x] for x, s in zip(langs, code[:, b], strict=True) if s < 0], 0)
        odds.append(np.log(yes / no))
        centre.append((yes @ odds[-1] + no @ odds[-1]) / 2)
        scale.append((yes @ odds[-1] - no @ odds[-1]) / 2)
    got = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in language_id.identify(docs(spark, asked), model).collect()}
    for i, t, *_ in asked:
        if not any(map(str.isalpha, t)):
            assert got[i] == ("und", 0.0)
            continue
        g = grams(t)
        loss = []
        for word in code:
            z = [((np.mean([odds[b][k] for k in g]) if g else 0.0) - centre[b]) / scale[b] * math.sqrt(min(max(len(g), 1), 400)) for b in range(code.shape[1])]
            parts = [float(np.logaddexp(0, -z[b] * word[b])) * scale[b] / np.mean(scale) for b in range(code.shape[1])]
            loss.append(sum(parts) / len(word))
        best = int(np.argmin(loss))
        assert got[i][0] == langs[best]
        assert got[i][1] == pytest.approx(1 / sum(math.exp(loss[best] - x) for x in loss), rel=1e-3)


def test_a_hundred_languages(spark):
    rng = np.random.default_rng(1)
    sounds = ["".join(chr(97 + c) for c in rng.integers(0, 26, 3)) for _ in range(400)]
    own = {f"l{k:03d}": [sounds[j] for j in rng.choice(400, 12, replace=False)] for k in range(100)}
    rows = [(1000 * k + i, " ".join(rng.choice(own[lang], 60)), lang, "a") for k, lang in enumerate(own) for i in range(6)]
    d = docs(spark, rows)
    got = language_id.identify(d.where("doc_id % 1000 = 5"), language_id.train(d.where("doc_id % 1000 < 5"))).select("lang", "lang_pred").collect()
    assert len(got) == 100 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95


def test_long_texts_are_summed_in_parts():
    rng = np.random.default_rng(3)
    bucket, weights = rng.integers(0, 50, 1000).astype(np.int32), rng.normal(size=(51, 3)).astype(np.float32)
    starts = np.zeros(1, np.int64)
    assert np.allclose(language_id._bit_sums(weights, bucket, starts, 64), language_id._bit_sums(weights, bucket, starts))


# -- 5


def test_revisits_through_the_query(spark, tmp_path):
    rows = [(k, f"http://h/{k}", "not found" if k % 3 == 0 else f"page {k}") for k in range(3000)] + [(9000, "http://h/x", None), (9001, "http://h/y", ""), (9002, None, "page 1")]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in warc.op5_warc(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    last = {}
    for k, _, html in rows:
        last[html or ""] = max(k, last.get(html or "", -1))
    for k, _, html in rows:
        data = (html or "").encode()
        to = last[html or ""]
        assert (got[k]["payload_bytes"], got[k]["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (got[k]["record_type"], got[k]["refers_to"]) == (("response", None) if to == k else ("revisit", to))


# -- 6


def pdf(n=1):
    data = b"%PDF-1.4\n"
    for k in range(n):
        data += b"xref\n0 1\ntrailer <<>>\nstartxref\n%d\n%%%%EOF\n" % len(data)
    return data.rstrip(b"\n")


def ogg_page(body, last, number):
    head = b"OggS\0" + bytes([4 if last else 0]) + bytes(8) + struct.pack("<II", 7, number)
    table = bytes([1, len(body)])
    crc = 0
    for x in head + bytes(4) + table + body:
        crc ^= x << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return head + struct.pack("<I", crc) + table + body


def sniffed(blob):
    return media.sniff(blob, media._automaton())[1]


def test_lengths_are_confirmed():
    wav = media.wav(b"ab" * 40)
    assert sniffed(b"fLaC\x80\0\0\x22" + bytes(34) + b"\xff\xf8" + wav) == [("audio/wav", 44, len(wav))]
    for n in (1, 2, 5):  # updated files go to their last trailer
        assert sniffed(b"zz" + pdf(n) + b"\ntail") == [("application/pdf", 2, len(pdf(n)))]
    assert sniffed(pdf(2) + b"\n" + pdf(1)) == [("application/pdf", 0, len(pdf(2))), ("application/pdf", len(pdf(2)) + 1, len(pdf(1)))]
    assert sniffed(b"%PDF-1.4\nstartxref\n99999\n%%EOF") == []
    pages = ogg_page(b"x" * 90, False, 0) + ogg_page(b"y" * 200, True, 1)
    assert sniffed(b"-" + pages + b"-") == [("application/ogg", 1, len(pages))]
    assert sniffed(pages[:-1] + b"!") == []
    assert sniffed(png() + GIF) == [("image/png", 0, len(png())), ("image/gif", len(png()), len(GIF))]


def test_repeated_magic_bytes_take_linear_time():
    import time

    for magic in (b"%PDF-", b"PK\x03\x04", b"PK\x05\x06" + bytes(18), b"OggS", b"BM", b"\x89PNG\r\n\x1a\n", b"startxref\n5\n%%EOF %PDF-", b"\xff\xd8\xff"):
        began = time.time()
        sniffed(magic * (200_000 // len(magic)))
        assert time.time() - began < 3, magic


def test_stored_media_by_hand(spark, tmp_path):
    docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(media.op6_media(spark, str(tmp_path)).collect(), key=lambda r: (nkey(r["doc_id"]), r["n_bytes"]))
    for r, (i, t, *_) in zip(got, sorted(HARD, key=lambda r: (nkey(r[0]), len((r[1] or "").encode()))), strict=True):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        stored = media.wav(payload)
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())


# -- 7


def test_document_scores_by_hand(spark):
    """Every labelling of a document's lines is enumerated; marginals are weighted by bytes."""
    labels = spark.createDataFrame([(1, 1), (7, 0), (5, 1), (12, 0)], "doc_id long, quality int")
    rows = [*HARD, (12, "BUY NOW!!! ||| $$$\nclick | here | now\n\n  \nzz zz zz zz", "en", "a"), (13, "A quiet line of prose.\nBUY ||| NOW\nAnd so it ended.\n{x} = 1;", "en", "a")]
    model = quality_crf.train(docs(spark, rows), labels)
    got = {r["doc_id"]: r["quality"] for r in quality_crf.score(docs(spark, rows), model).collect()}
    for i in (12, 13, 1):
        text = next(t for k, t, *_ in rows if k == i).encode()
        lines = quality_crf.lines_of(quality_crf.Block(np.frombuffer(text, np.uint8), np.zeros(1, np.int64), np.array([len(text)]), 0))
        scores = (lines.x - model.mean) / model.scale @ model.weights
        n = len(scores)
        paths = [[k >> j & 1 for j in range(n)] for k in range(2**n)]
        w = np.array([math.exp(sum(scores[j] * path[j] for j in range(n)) + sum(model.transitions[path[j], path[j + 1]] for j in range(n - 1))) for path in paths])
        good = (w[:, None] * np.array(paths)).sum(0) / w.sum()
        size = [len(x) for x in text.split(b"\n") if x.strip()]
        assert got[i] == pytest.approx(float(np.dot(good, size) / sum(size)), abs=1e-9)


def test_fitting_lines_are_no_prefix(spark):
    text = "\n".join(["Plain prose stands here in a line."] * 500 + ["||| BUY NOW $$$ !!!"] * 500)
    rows = [(i, text, "en", "a") for i in range(30)]
    seen = docs(spark, rows).select(F.xxhash64("doc_id").alias("at"), F.lit(1).alias("label"), "text").mapInArrow(quality_crf._line_rows(100), "label int, x binary").collect()
    sizes = {np.frombuffer(bytes(r["x"]), np.float32).reshape(-1, quality_crf.N_FEATURES).shape[0] for r in seen}
    assert sizes == {100} and len({bytes(r["x"]) for r in seen}) > 1


# -- 8


def test_rows_are_judged_by_their_own_text(spark):
    item = ITEMS[0][1]
    rows = [(None, item, "en", "a"), (None, "a clean text without an id", "en", "a"), (4, item, "en", "a"), (4, "another clean text", "en", "a")]
    for most in (1 << 20, 12):
        kept = decontaminate.drop_contaminated(docs(spark, rows), benchmark(spark), most_words=most)
        assert sorted(r["text"] for r in kept.collect()) == ["a clean text without an id", "another clean text"]


# -- 9


def test_lines_of_rows_without_ids(spark):
    line = "All rights reserved by everyone.\t\r"
    rows = [(None, f"text number {k} of its own\n{line}", "en", f"s{k}") for k in range(6)] * 2
    out = line_dedup.dedup_lines(docs(spark, rows)).collect()
    assert sorted(r["text"] for r in out) == sorted(t.split("\n")[0] for _, t, *_ in rows)
    plan = line_dedup.dedup_lines(docs(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan  # what is removed is small, so texts aren't shuffled


# -- 10


def test_mix_is_the_same_however_rows_are_dealt(spark):
    rows = [(7, "w " * k, "en", "a") for k in range(1, 6)] + [(9, "v " * 4, "en", "b")] + [(None, f"n{k} " * (k + 1), "en", "b") for k in range(20)] + [(k, "u " * 3, "en", f"s{k % 40}") for k in range(100, 300)]
    found = {n: sorted((str(r["doc_id"]), str(r["source"]), r["size"], r["target"], r["taken"]) for r in mixing.mix(docs(spark, rows).repartition(n, F.xxhash64("text"))).collect()) for n in (1, 3, 7)}
    assert found[1] == found[3] == found[7]
