import hashlib
import random
import zlib

import pytest

from sluice.llm import periods, queries


def brute(words, least=periods.LEAST, times=periods.TIMES):
    """Runs by definition: for each period the longest stretches, smallest periods first."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                start, length = i, j - i + q
                block = words[start : start + q]
                smallest = next(d for d in range(1, q + 1) if q % d == 0 and block == block[:d] * (q // d))
                if length >= 2 * q and smallest < q:
                    pass  # a run of a smaller period
                elif length >= max(least, times * q):
                    out.append((start, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def left(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def sample(rng):
    alphabet = [b"a", b"b", b"c", b"d", b"e"][: rng.randint(1, 5)]
    words = []
    for _ in range(rng.randint(1, 6)):
        block = rng.choices(alphabet, k=rng.randint(1, 14))
        words += block * rng.randint(1, 8) + block[: rng.randint(0, len(block))]
    return words


def test_runs_equal_their_definition(monkeypatch):
    rng = random.Random(1)
    documents = [sample(rng) for _ in range(1500)] + [[b"x"] * 500, [], [b"x"] * 24, [b"x"] * 23]
    a, b = [b"a"], [b"a", b"b"]
    for _ in range(9):
        a, b = b, b + a
    documents.append(b)  # a Fibonacci string: many runs
    want = [brute(d) for d in documents]
    for at in range(0, len(documents), 50):
        assert periods.find_in(documents[at : at + 50]) == want[at : at + 50]
    assert sum(map(bool, want)) > 300
    monkeypatch.setattr(periods, "AT_ONCE", 7)
    assert periods.find_in(documents[-40:]) == want[-40:]
    assert all(periods.collapsed(d, r) == left(d, r) for d, r in zip(documents, want))


def test_short_thresholds_find_all_runs(monkeypatch):
    for name, n in (("LEAST", 2), ("TIMES", 2), ("WINDOW", 1)):
        monkeypatch.setattr(periods, name, n)
    rng = random.Random(2)
    documents = [rng.choices([b"a", b"b", b"c"], k=rng.randint(0, 60)) for _ in range(400)]
    assert periods.find_in(documents) == [brute(d, 2, 2) for d in documents]


def plant(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def check(rows, texts):
    digest = lambda b: hashlib.sha256(b).hexdigest()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts) and set(got) == set(texts)
    with_runs = 0
    for doc_id, text in texts.items():
        words = plant(doc_id, (text or "").encode().split())
        runs, r = brute(words), got[doc_id]
        with_runs += bool(runs)
        assert r["n_runs"] == len(runs)
        assert r["runs_sha256"] == digest("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode())
        assert r["collapsed_sha256"] == digest(b" ".join(left(words, runs)))
        top = None
        for run in runs:
            if top is None or run[1] * top[2] > top[1] * run[2]:
                top = run
        assert (r["start"], r["length"], r["period"]) == (top or (None,) * 3)
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if top else None)
    return with_runs


@pytest.fixture
def written(tmp_path):
    def write(df):
        df.write.parquet(str(tmp_path / "documents.parquet"))
        return str(tmp_path)

    return write


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    assert check(queries.op13_periods(spark, "/root/testdata/sf0.001").collect(), texts) > 5


def test_odd_rows(spark, odd_documents, no_documents, written):
    rows = queries.op13_periods(spark, written(odd_documents)).collect()
    assert len(rows) == odd_documents.count()
    texts = {r["doc_id"]: r["text"] for r in odd_documents.collect() if r["doc_id"] is not None}
    check([r for i, r in enumerate(rows) if r["doc_id"] is not None and r["doc_id"] not in {x["doc_id"] for x in rows[:i]}], texts)
    assert [r["n_runs"] for r in rows if r["doc_id"] is None] == [0]
    assert len({tuple(r) for r in rows if r["doc_id"] == 159}) == 1
    assert periods.find_runs(no_documents).count() == 0
