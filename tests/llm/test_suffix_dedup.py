import hashlib
import random

import numpy as np

from sluice.llm import suffix_dedup
from sluice.llm.suffix_array import equal_prefixes, suffix_array


def brute(rows, length=100):
    """Rows (id, text) in order of id; the result by row."""
    seen, out = set(), []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            else:
                seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(i, t, 1, b"x") for i, t in rows], "doc_id long, text string, doc int, marks binary").repartition(5)
    got = suffix_dedup.dedup(df).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(brute(rows))


def test_suffix_array_equals_sorting():
    rng = np.random.default_rng(0)
    for _ in range(800):
        s = rng.integers(1, rng.integers(2, 6), rng.integers(0, 40))
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    data = np.frombuffer(b"abcdefghij" * 5 + b"x" * 30, np.uint8)
    assert equal_prefixes(data, np.array([0, 10, 20, 21]), 17).tolist() == [False, True, True, False]


def test_equals_brute_force(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgé", k=rng.randint(1, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passages = [text(rng.randint(10, 60)) for _ in range(8)]
    rows = []
    for i in range(120):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            p = p[a : a + rng.randint(50, 400)]
            if rng.random() < 0.3:
                k = rng.randint(0, len(p))
                p = p[:k] + "#" + p[k + 1 :]
            parts += [p, text(rng.randint(0, 20))]
        rows.append((i * 3, "".join(parts)))
    rows += [(1000 + i, rows[5][1]) for i in range(30)]
    check(spark, rows)


def test_periodic_and_odd_texts(spark):
    base = "".join(random.Random(1).choices("abcdefghijklmnop ", k=300))
    rows = [(1, None), (2, ""), (3, "x" * 99), (4, "x" * 100), (5, "x" * 350), (6, "ab" * 200), (7, "abc" * 90 + base), (8, base), (9, base[1:]), (10, "é" * 75), (11, "é" * 51)]
    check(spark, rows)


def test_long_texts_are_taken_in_pieces(spark, monkeypatch):
    rng = random.Random(2)
    long = "".join(rng.choices("abcdefghijklmnop ", k=5000))
    rows = [(1, long), (2, long[700:2900] + "!" + long[100:400]), (3, long[4000:] + long[:150])]
    check(spark, rows)
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "PIECE", 1024)
    pieces = [suffix_dedup.contexts(d, o) for _, d, o, _ in suffix_dedup._pieces(pa.array([long]))]
    assert sum(p[2].sum() for p in pieces) == len(long) - 99


def test_repeated_and_null_rows(spark, odd_documents, no_documents):
    assert suffix_dedup.dedup(odd_documents).count() == odd_documents.count()
    assert suffix_dedup.dedup(no_documents).count() == 0
    base = "".join(random.Random(3).choices("abcdefghijklmnop ", k=300))
    got = suffix_dedup.dedup(spark.createDataFrame([(5, base), (5, base), (None, base), (9, base)], "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in got) == [("5", 0), ("5", 0), ("9", 300), ("None", 300)]


def test_contexts_that_share_a_minimizer_only_are_not_sorted(spark):
    """Strings of a minimizer's length in otherwise different texts repeat no window; one byte in a passage leaves it repeated on either side."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    common = [text(24) for _ in range(20)]
    rows = [(i, text(120) + c + text(120)) for i in range(6) for c in common]
    told = lambda rows: suffix_dedup.mark_contexts(spark.createDataFrame(rows, "doc long, text string").selectExpr("doc", "xxhash64(text) AS twin", "text"), 8)
    assert told(rows).count() == 0
    check(spark, [(i, t) for i, (_, t) in enumerate(rows)])
    passage = text(400)
    assert told([(1, passage), (2, passage[:200] + "#" + passage[201:])]).where("kind = 2").count() > 0
