"""Small corpora and plain evaluations of the contracts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
LONG = " ".join(f"word{i * 7919 % 1013}" for i in range(3000))
#: Nulls, empty texts, blanks, repeated rows, ties, a very long text, letters beyond ASCII, a NUL.
HARD = [
    (1, "The cat sat on the mat and looked at the other cat.\nSecond line here, plainly written.", "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, "   \n\t ", "en", None), (5, "Über die Brücke gehen wir zum großen Fluß und dann nach Hause.", "de", "b"),
    (6, "one", "en", "b"), (7, LONG, "en", "c"), (8, LONG, "en", "c"), (9, LONG.replace("word12 ", "other "), "en", None), (9, LONG.replace("word12 ", "other "), "en", None), (10, "!!! ### 123", "en", "a"), (11, "a\x00b c d e f g", "en", "a"), (None, "no id at all, but some text", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def docs(spark, rows=HARD, schema=SCHEMA):
    """With extra columns whose names clash with those that operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema)
    return df.select("*", F.lit(1).alias("n_chars"), F.lit("x").alias("size"), F.lit(2).alias("row"), F.lit("t").alias("target"))


def sample(sf):
    import duckdb

    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{sf}/documents.parquet'").fetchall()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def near_duplicate_components(rows, width, percent):
    """{id: (set size, smallest id reachable)} by comparing all documents that share a shingle."""
    sets = {}
    for i, t, *_ in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            having[s].append(i)
    for i in sets:
        shared = Counter(j for s in sets[i] for j in having[s] if j < i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def repeated_bytes(rows, length):
    """[(id, bytes, removed, spans, digest of the rest)] by comparing all windows."""
    windows = Counter()
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    for _, b in texts:
        windows.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if windows[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n
