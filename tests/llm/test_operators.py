"""Each operator against brute force, an exact round trip or held-out accuracy, and on hard rows."""

import base64
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakedoc.llm import decontaminate, language_id, line_dedup, lm_scoring, media, minhash, mixing, quality_crf, suffix_dedup, warc
from lakedoc.llm.components import connected_components
from lakedoc.llm.registry import queries

from .helpers import HARD, LONG, SCHEMA, docs, fold, near_duplicate_components, repeated_bytes, sample, words


def nkey(v):
    return (v is None, v if v is not None else 0)


# -- 1


def test_lm_base_and_counts(spark, sf):
    got = {r["doc_id"]: r for r in lm_scoring.op1_lm_scoring(spark, sf).collect()}
    tokens = {i: [*words(t), None] for i, t, *_ in sample(sf)}
    taught = Counter(w for i, ws in tokens.items() if fold(i, 10) for w in ws)
    n, v = sum(taught.values()), len(taught)
    for i, ws in tokens.items():
        r = got[i]
        base = sum(math.log10((taught[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(i, 10) == 0, len(ws), sum(taught[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])


def all_segmentations(codes, table):
    if not codes:
        return 1.0
    return sum(table[codes[:k]] * all_segmentations(codes[k:], table) for k in range(1, len(codes) + 1) if codes[:k] in table)


def test_lattice_sums_every_segmentation():
    table = {(lm_scoring.MARK,): 0.1, tuple(b"a"): 0.2, tuple(b"b"): 0.1, (lm_scoring.MARK, *b"a"): 0.15, tuple(b"ab"): 0.2, tuple(b"aba"): 0.05, (lm_scoring.MARK, *b"ab"): 0.1, tuple(b"ba"): 0.1}
    hashes = np.array([lm_scoring._hash(list(c)) for c in table], np.uint64)
    order = np.argsort(hashes)
    pieces = lm_scoring.Pieces(hashes[order], np.log(np.array(list(table.values())))[order], 3)
    for w in (b"a", b"ab", b"abab", b"bbbb", b"ababab" * 2, b"ab" * 40):
        want = all_segmentations((lm_scoring.MARK, *w), table) if len(w) < 15 else None
        got = lm_scoring.word_logp([w], pieces)[0]
        one = lm_scoring.long_forward(lm_scoring._codes([w], len(w) + 1)[0], pieces)[-1]
        assert got == pytest.approx(one)
        if want is not None:
            assert got == pytest.approx(math.log(want))
    many, one = lm_scoring.expected_uses([b"abab"], np.array([2.0]), pieces), lm_scoring.long_expected(lm_scoring._codes([b"abab"], 5)[0], 2.0, pieces)
    assert np.allclose(many, one)


def test_lm_learns_nothing_from_held_out(spark):
    rows = [(i, f"common words here number{i} stand", "en", "a") for i in range(40)]
    a = {r["doc_id"]: r["score"] for r in lm_scoring.score_documents(docs(spark, rows)).collect()}
    b = {r["doc_id"]: r["score"] for r in lm_scoring.score_documents(docs(spark, [(i, t if fold(i, 10) else "zebra quagga", lang, s) for i, t, lang, s in rows])).collect()}
    assert all(a[i] == pytest.approx(b[i]) for i in a if fold(i, 10))


# -- 2


@pytest.mark.parametrize("options", [{}, {"hot": 3, "bucket_bytes": 50_000}])
def test_repeated_spans(spark, sf, options):
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in suffix_dedup.repeated_spans(spark.read.parquet(f"{sf}/documents.parquet"), **options).collect())
    assert got == sorted(repeated_bytes(sample(sf), 200))


def test_repeated_spans_hard(spark):
    rows = [*HARD, (20, "xy" * 400, "en", "a"), (21, "ab" * 99 + "unique", "en", "a"), (22, LONG[100:450], "en", "a"), (23, "q" + LONG[1000:1199], "en", "a"), (24, LONG[2000:2200], "en", "a")]
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in suffix_dedup.repeated_spans(docs(spark, rows)).collect()), key=lambda r: (nkey(r[0]), r[1:]))
    assert got == sorted(repeated_bytes(rows, 200), key=lambda r: (nkey(r[0]), r[1:]))


@pytest.mark.parametrize("length", [1, 2, 7, 8, 21, 64, 200])
def test_merge_finds_the_windows_that_repeat(length):
    rng = np.random.default_rng(length)
    make = lambda n: bytes(rng.integers(97, 99 if length < 20 else 123, n, np.uint8))
    common = make(3 * length + 300)
    texts = [make(n) for n in (length, suffix_dedup.MARK - 1, suffix_dedup.MARK, 2 * suffix_dedup.MARK, 700)] + [make(30) + common, common[: length + 9] + make(5), b"\0" + common[-length - 1 :], make(40) * 12]
    weights = np.array([1, 1, 2, 1, 1, 1, 3, 1, 1])
    counted = Counter(t[k : k + length] for t, w in zip(texts, weights, strict=True) for k in range(len(t) - length + 1) for _ in range(w))
    parts = [[0, 3, 6], [1, 4, 7, 8], [2], [5]]
    shards = [suffix_dedup.Shard(*((made := suffix_dedup.transform([texts[k] for k in p]))[0], np.array([len(texts[k]) for k in p]), made[1])) for p in parts]
    for p, s in zip(parts, shards, strict=True):
        assert sorted(zip(s.text.tolist(), s.at.tolist(), strict=True)) == [(n, at) for n, k in enumerate(p) for at in range(len(texts[k]) + 1)]
        assert all(s.bwt[row] == (texts[p[n]][at - 1] + 1 if at else 0) for row, (n, at) in enumerate(zip(s.text, s.at, strict=True)))
    shard, text, at = suffix_dedup.repeated(shards, [weights[p] for p in parts], length)
    assert sorted((parts[s][t], a) for s, t, a in zip(shard.tolist(), text.tolist(), at.tolist(), strict=True)) == [(k, a) for k, t in enumerate(texts) if weights[k] == 1 for a in range(len(t) - length + 1) if counted[t[a : a + length]] > 1]


def test_texts_that_only_meet_copies_are_not_merged():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    a, b, c, d = (bytes(rng.integers(97, 123, 300, np.uint8)) for _ in range(4))
    # (name, weight, text): two copied texts of one name, a copied one that shares its name with a single one, a name alone
    rows = [(1, 2, a), (1, 5, a[20:] + b[:10]), (2, 2, c), (2, 1, c[:250] + b), (3, 2, d)]
    batch = pa.RecordBatch.from_pylist([{"bucket": 0, "shard": k % 2, "digest": b"%d" % k, "name": n, "weight": w, "text": t} for k, (n, w, t) in sorted(enumerate(rows), key=lambda r: r[0] % 2)])
    parts = list(suffix_dedup._transforms(iter([batch])))
    assert sum(len(p) for part in parts for p in part.column("lengths").to_pylist()) == 2
    found = {d: s for out in suffix_dedup._merged(200)(iter(parts)) for d, s in zip(*(c.to_pylist() for c in out.columns), strict=True)}
    assert found == {b"%d" % k: [{"lo": 0, "hi": 250 if k == 3 else len(t)}] for k, (_, _, t) in enumerate(rows)}


def test_passage_in_many_surroundings_is_no_single_bucket(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(7)
    around = lambda n: bytes(rng.integers(97, 123, n, np.uint8)).decode()
    passage = around(230)
    rows = [(k, around(60) + passage + around(60), "en", "a") for k in range(400)] + [(k, passage + around(30), "en", "a") for k in (900, 901)] + [(902, rows_end := around(250), "en", "a"), (903, rows_end, "en", "b")]
    merged, folder = suffix_dedup._merged, str(tmp_path)

    def watched(length):
        run = merged(length)

        def noted(batches):
            import os
            import uuid

            for batch in batches:
                for bucket, lengths in zip(batch.column("bucket").to_pylist(), batch.column("lengths").to_pylist(), strict=True):
                    with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                        f.write(f"{bucket} {sum(lengths)}")
                yield from run(iter([batch]))

        return noted

    monkeypatch.setattr(suffix_dedup, "_merged", watched)
    found = suffix_dedup.repeated_spans(docs(spark, rows), hot=100, bucket_bytes=5_000)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in found.collect())
    held = Counter()
    for path in tmp_path.iterdir():
        bucket, n = path.read_text().split()
        held[bucket] += int(n)
    assert got == sorted(repeated_bytes(rows, 200))
    assert held and max(held.values()) <= 40_000


# -- 3


@pytest.mark.parametrize(("width", "block_bytes"), [(4, 8 << 20), (5, 8 << 20), (4, 20_000)])
def test_near_duplicates(spark, sf, width, block_bytes):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"), width=width, block_bytes=block_bytes).collect()}
    assert got == near_duplicate_components(sample(sf), width, 80)


def test_near_duplicates_chain_and_hard(spark):
    base = [f"w{i}" for i in range(200)]
    chain = [(100 + k, " ".join([f"x{k}_{j}" for j in range(8 * k)] + base[8 * k :]), "en", "a") for k in range(6)]  # neighbours are alike, ends are not
    rows = [*HARD, *chain]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs(spark, rows), width=4, block_bytes=2000).collect()]
    want = near_duplicate_components([r for r in rows if r[0] is not None], 4, 80)
    assert {g[0]: (g[1], g[2]) for g in got if g[0] is not None} == want
    assert all(g[3] == (g[0] == g[2]) for g in got if g[0] is not None)
    assert [g[2:] for g in got if g[0] is None] == [(None, True)] or [g[2] for g in got if g[0] is None] == [None]
    assert len(got) == len(rows)


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**63, 800).astype(np.uint64)
    a, b = np.sort(common[:700]), np.sort(np.concatenate([common[100:], rng.integers(0, 2**63, 0).astype(np.uint64)]))
    sig = minhash.signatures([a, b])
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((sig[0] == sig[1]).mean() - true) < 0.1


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (300, 200), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 200: 100, 300: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 4


def test_language_accuracy(spark, sf):
    got = language_id.op4_language_id(spark, sf).collect()
    truth = {i: lang for i, _, lang, _ in sample(sf)}
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) for r in got)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_hard(spark):
    model = language_id.train(docs(spark))
    got = [(r["text"], r["lang_pred"], r["lang_score"]) for r in language_id.identify(docs(spark), model).collect()]
    assert all((p == "und") == (t is None or not any(map(str.isalpha, t))) for t, p, _ in got)
    nothing = language_id.train(docs(spark).where("false"))
    assert {r["lang_pred"] for r in language_id.identify(docs(spark), nothing).collect()} == {"und"}
    single = language_id.train(docs(spark).where("lang = 'de'"))
    assert {(r["lang_pred"], r["lang_score"]) for r in language_id.identify(docs(spark), single).where("doc_id = 5").collect()} == {("de", 1.0)}
    assert language_id.drop_unidentified(docs(spark)).columns == docs(spark).columns


@pytest.mark.parametrize("text", ["a", "ab", "é", "abc"])
def test_language_of_short_tables(spark, text):
    two = docs(spark, [(1, "the cat sat on the mat", "en", "a"), (2, "über die Brücke", "de", "a")])
    alone = docs(spark, [(3, text, "en", "a")]).coalesce(1)
    model = language_id.train(two.union(alone))
    assert [r["lang_pred"] in ("de", "en") for r in language_id.identify(alone, model).collect()] == [True]
    among = language_id.identify(two.union(alone).coalesce(1), model).where("doc_id = 3").select("lang_pred", "lang_score").collect()
    assert language_id.identify(alone, model).select("lang_pred", "lang_score").collect() == among


@pytest.mark.parametrize("n", [2, 4, 7, 12, 30])
def test_codewords_are_apart(n):
    code = language_id.codewords(n)
    apart = min(int((code[a] != code[b]).sum()) for a in range(n) for b in range(a))
    assert apart >= (code.shape[1] // 2 if n <= 7 else code.shape[1] // 4) and apart > 0


# -- 5


def test_warc_query(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r["page_id"]: r for r in warc.op5_warc(spark, sf).collect()}
    assert len(got) == len(pages)
    for p in pages:
        b = (p["html"] or "").encode()
        assert (got[p["page_id"]]["payload_bytes"], got[p["page_id"]]["payload_digest"], got[p["page_id"]]["record_type"]) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response")


@pytest.mark.parametrize("compress", ["true", "false"])
def test_warc_round_trip_revisits_and_pushdown(spark, tmp_path, compress):
    warc.register(spark)
    rows = [(1, "http://a/\r\nx", "same"), (2, "http://b", "same"), (3, None, None), (4, "http://c", ""), (5, "http://d", "WARC/1.1\r\n\r\nß" * 50), (None, "http://e", "same"), (5, "http://d", "WARC/1.1\r\n\r\nß" * 50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("revisit", F.lit("clash")).coalesce(2)
    path = f"file://{tmp_path}/w"
    warc.with_revisits(df).write.format("warc").mode("append").option("path", path).option("compress", compress).option("target_bytes", 300).save()
    back = spark.read.format("warc").option("path", path).load()
    got = sorted((r["record_id"], r["record_type"], r["refers_to"] or "", bytes(r["payload"]).decode()) for r in back.collect())
    weird = "WARC/1.1\r\n\r\nß" * 50
    assert got == sorted([("<urn:page:1>", "revisit", "<urn:page:2>", ""), ("<urn:page:2>", "response", "", "same"), ("<urn:page:3>", "revisit", "<urn:page:4>", ""), ("<urn:page:4>", "response", "", ""), ("<urn:page:5>", "response", "", weird), ("<urn:page:5>", "response", "", weird), ("<urn:page:none>", "revisit", "<urn:page:2>", "")])
    few = back.where((F.col("record_type") == "revisit") & F.col("refers_to").startswith("<urn:page:2"))
    assert sorted(r["record_id"] for r in few.collect()) == ["<urn:page:1>", "<urn:page:none>"]
    heads = spark.read.format("warc").schema("record_id string, target_uri string, http_content_length long").option("path", path).load()
    assert {(r["record_id"], r["target_uri"], r["http_content_length"]) for r in heads.collect()} >= {("<urn:page:1>", "http://a/ x", 4), ("<urn:page:3>", None, 0)}


def test_warc_empty_and_foreign(spark, tmp_path):
    import gzip

    warc.register(spark)
    path = f"file://{tmp_path}/e"
    warc.with_revisits(spark.createDataFrame([], "page_id long, url string, html string")).write.format("warc").mode("append").option("path", path).save()
    assert spark.read.format("warc").option("path", path).load().count() == 0
    plain = warc.record({"record_type": "response", "record_id": "<x>", "content_type": "application/http; msgtype=response", "payload": b"abc"}) * 2
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.warc.gz").write_bytes(gzip.compress(plain))
    (tmp_path / "f" / "b.warc").write_bytes(plain)
    assert [bytes(r["payload"]) for r in spark.read.format("warc").option("path", str(tmp_path / "f")).load().collect()] == [b"abc"] * 4
    (tmp_path / "f" / "c.warc").write_bytes(plain[:-30])
    with pytest.raises(Exception, match="cut off"):
        spark.read.format("warc").option("path", str(tmp_path / "f")).load().collect()


# -- 6


def test_media_query(spark, sf):
    got = {r["doc_id"]: r for r in media.op6_media(spark, sf).collect()}
    for i, t, *_ in sample(sf):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["feature"].startswith("audio/wav;corrected=1;objects=1;offset=24;")


def test_media_query_keeps_carved_data_in_their_task(spark, sf):
    plan = media.op6_media(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2  # one that stores and one that reads back, each a Python worker of every task


def test_media_derived(spark):
    import pyarrow as pa

    df = spark.createDataFrame([(1, b"__" + GIF + GIF, "text/plain"), (2, b"plain", "text/plain"), (3, None, None)], "i long, blob binary, declared string")
    seen = media.sniff_media(df, id_col="i", blob_col="blob", declared_col="declared", derive=lambda kind, corrected, objects: (f"{kind} {corrected}", [o for _, o, _ in objects], b"".join(d for *_, d in objects)), derived=pa.schema([("what", pa.string()), ("at", pa.list_(pa.int64())), ("data", pa.binary())]))
    assert seen.columns == ["i", "what", "at", "data"]
    assert [(r["i"], r["what"], r["at"], bytes(r["data"])) for r in seen.sort("i").collect()] == [(1, "image/gif True", [2, 2 + len(GIF)], GIF + GIF), (2, "text/plain False", [], b""), (3, "application/octet-stream False", [], b"")]


def png(data=b"x"):
    chunk = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")


GIF = b"GIF89a\x01\x00\x01\x00\x00\x00\x00" + b"\x2c" + bytes(9) + b"\x02\x02\x4c\x01\x00" + b"\x3b"


def test_media_sniffing(spark):
    import gzip as gz
    import io
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hello")
    wav, packed = media.wav(b"ab" * 40), gz.compress(b"hello" * 9)
    cases = [
        (png(), "image/jpeg", "image/png", [(0, len(png()))]),
        (b"junk" + GIF + b"more" + png() + b"tail", "text/plain", "image/gif", [(4, len(GIF)), (8 + len(GIF), len(png()))]),
        (b"__" + wav, "audio/wav", "audio/wav", [(2, len(wav))]),
        (media.wav(png() + b"\0" * (len(png()) % 2)), None, "audio/wav", [(0, 44 + len(png()) + len(png()) % 2)]),
        (z.getvalue() + b"x", None, "application/zip", [(0, len(z.getvalue()))]),
        (b"aa" + packed, None, "application/gzip", [(2, len(packed))]),
        (png()[:-1], "image/png", "application/octet-stream", []),
        ("BM GIF89a RIFF are only letters, ü".encode(), None, "text/plain", []),
        (b"", "image/png", "application/octet-stream", []),
        (None, None, "application/octet-stream", []),
    ]
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i long, blob binary, declared string").withColumn("objects", F.lit(0))
    got = {r["i"]: r for r in media.sniff_media(df, id_col="i", blob_col="blob", declared_col="declared").collect()}
    for i, (blob, declared, kind, spans) in enumerate(cases):
        assert (got[i]["true_type"], [(o["offset"], o["length"]) for o in got[i]["objects"]]) == (kind, spans), i
        assert got[i]["corrected"] == (declared is not None and declared != kind)
        assert all(bytes(o["data"]) == blob[o["offset"] : o["offset"] + o["length"]] for o in got[i]["objects"])


# -- 7


def test_quality_held_out(spark, sf):
    got = quality_crf.op7_quality(spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r["held_out"] == (fold(r["doc_id"], 3) == 1) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)
    held = [(labels[r["doc_id"]], r["score"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for y, s in held if y], [s for y, s in held if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_crf_marginals_are_exact():
    rng = np.random.default_rng(0)
    scores, t = rng.normal(size=7), rng.normal(size=(2, 2))
    lo, hi = np.array([0, 4, 4]), np.array([4, 4, 7])
    good, joint, z = quality_crf.marginals(scores, t, lo, hi)
    want, pairs, total = np.zeros(7), np.zeros((2, 2)), 0.0
    for a, b in zip(lo, hi, strict=True):
        n = b - a
        if not n:
            continue
        paths = [[k >> i & 1 for i in range(n)] for k in range(2**n)]
        w = np.array([math.exp(sum(scores[a + i] * p[i] for i in range(n)) + sum(t[p[i], p[i + 1]] for i in range(n - 1))) for p in paths])
        total += math.log(w.sum())
        for p, q in zip(paths, w / w.sum(), strict=True):
            want[a:b] += q * np.array(p)
            for i in range(n - 1):
                pairs[p[i], p[i + 1]] += q
    assert np.allclose(good, want) and np.allclose(joint, pairs) and z == pytest.approx(total)


def test_quality_hard(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (5, 1, 0), (7, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_crf.train(docs(spark), labels)
    got = quality_crf.score(docs(spark), model).collect()
    assert len(got) == len(HARD) and all(0 <= r["quality"] <= 1 for r in got)
    assert {r["quality"] for r in got if r["n_lines"] == 0} == {model.prior}
    untaught = quality_crf.train(docs(spark), labels.where("false"))
    assert {r["quality"] for r in quality_crf.score(docs(spark), untaught).collect()} == {0.5}


# -- 8


def brute_hits(rows, items, width=13):
    cut = lambda t: __import__("re").findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))
    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[k : k + width])].add("null" if i is None else str(i))
    out = []
    for i, t, *_ in rows:
        w, hit, found = cut(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[g]
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=lambda r: (nkey(r[0]), r[1:]))


@pytest.mark.parametrize("options", [{}, {"most_words": 60, "shard_words": 3000}])
def test_decontamination(spark, sf, options):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(8).collect()]
    rows = [*sample(sf)[:60], *HARD, (900, "x " + items[0][1] + " y", "en", "a"), (901, (items[1][1] + " ") * 3, "en", "a"), (902, LONG + " " + items[2][1], "en", "a")]
    items += [(50, "The cat"), (51, "the CAT!"), (52, None), (53, ""), (54, " ".join(LONG.split()[40:60])), (54, "one"), (None, "some text")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(0))
    found = decontaminate.hits(decontaminate.find_spans(docs(spark, rows), bench, **options)).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], [x for x in r["items"]]) for r in found), key=lambda r: (nkey(r[0]), r[1:]))
    assert got == brute_hits(rows, items)


def test_empty_benchmark(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.hits(decontaminate.find_spans(docs(spark), bench)).where("contaminated OR n_hit > 0").count() == 0
    assert decontaminate.drop_contaminated(docs(spark), bench).count() == len(HARD)


def test_suffix_order_and_fm_index():
    rng = np.random.default_rng(3)
    text = np.concatenate([np.append(rng.integers(1, 4, n), 0) for n in (1, 30, 5, 200, 0, 200)] + [np.array([1, 2, 3, 1, 2, 3, 0] * 20)])
    ends = np.flatnonzero(text == 0)
    cut = lambda i: tuple(text[i : ends[np.searchsorted(ends, i)]])
    order = decontaminate.sort_suffixes(text)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: (cut(i), i))
    index = decontaminate.FmIndex(text, 4)
    for phrase in ((1,), (1, 2), (2, 3, 1), (3, 3, 3, 3, 3, 3, 3), (1, 2, 3, 1)):
        lo, hi = index.search(np.array([phrase]), np.array([len(phrase)]))
        at = index.locate(np.arange(lo[0], hi[0]))
        assert sorted(at.tolist()) == [i for i in range(len(text)) if tuple(text[i : i + len(phrase)]) == phrase]


# -- 9


def test_line_dedup_hard(spark):
    line = "All rights reserved by everyone."
    rows = [*HARD, *[(50 + k, f"own line number {k} stands here\n {line} \nshort\n\nend", "en", s) for k, s in enumerate(["a", "b", "c", None, "a"])], (60, "own line number 0 stands here", "en", "a"), (61, "own line number 0 stands here", "en", "b"), (62, "own line number 0 stands here", "en", "c")]
    out = line_dedup.dedup_lines(docs(spark, rows), min_sites=4)
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed_lines"]) for r in out.collect()}
    assert out.count() == len(rows)
    assert got[50] == ("own line number 0 stands here\nshort\n\nend", 5, 1)
    assert got[60] == ("own line number 0 stands here", 1, 0)  # on three sites
    assert got[2] == (None, 0, 0) and got[3] == ("", 1, 0)
    assert out.columns[: len(docs(spark).columns)] == docs(spark).columns
    assert line_dedup.dedup_lines(docs(spark, []), min_sites=4).count() == 0


def test_line_dedup_is_native(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "cut", lambda df: df)  # so that the plan shows all steps
    plan = line_dedup.dedup_lines(docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "hll_sketch_agg" in plan


# -- 10


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    """Reshare what is above the caps until nothing is."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    full, total = {}, sum(sizes.values())
    while True:
        rest = total - sum(full.values())
        free = [s for s in order if s not in full]
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free} if free else {}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return {**full, **share}
        full |= {s: cap * sizes[s] for s in over}


def test_mixing(spark, sf):
    out = mixing.op10_mixing(spark, sf).collect()
    truth = {i: (len(words(t)), s) for i, t, _, s in sample(sf)}
    sizes = Counter()
    for n, s in truth.values():
        sizes[s] += n
    want = plain_targets(sizes)
    taken = Counter()
    for r in out:
        n, s = truth[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, sizes[s]) and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * n
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    again = mixing.op10_mixing(spark, sf).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_mixing_hard(spark):
    out = mixing.mix(docs(spark)).collect()
    assert len(out) == len(HARD)
    taken, target = Counter(), {}
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    # rows with one id share a key, but not a place, so the sums hold
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert mixing.mix(docs(spark, [])).count() == 0


def test_mixing_prefers_quality(spark):
    rows = [(i, "w " * 10, "en", "a") for i in range(400)] + [(1000 + i, "w " * 10, "en", "b") for i in range(400)]
    quality = spark.createDataFrame([(i, 4.0 if i % 2 else 0.25) for i in [*range(400), *range(1000, 1400)]], "doc_id long, quality double")
    out = [r for r in mixing.mix(docs(spark, rows), quality=quality, weights=(1, 3)).collect() if r["source"] == "a"]
    extra = Counter()
    for r in out:
        extra[r["quality"]] += r["taken"]
    assert extra[4.0] > 1.5 * extra[0.25]


# -- all


@pytest.mark.parametrize("name", ["op1_lm_scoring", "op2_suffix_dedup", "op3_near_dedup", "op4_language_id", "op5_warc", "op6_media", "op7_quality", "op8_decontaminate", "op9_line_dedup", "op10_mixing"])
def test_empty_tables(spark, tmp_path, name):
    for t, s in (("documents", SCHEMA), ("pages", "page_id long, url string, html string"), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], s).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert queries()[name](spark, str(tmp_path)).count() == 0
