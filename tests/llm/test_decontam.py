import random

from sluice.llm import decontam


def grams(text):
    w = (text or "").split()
    w = [x.lower() for x in w]
    return {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(docs, items):
    out = set()
    for d, t in docs:
        for i, b in items:
            g = grams(b)
            if d is not None and i is not None and g and 100 * len(g & grams(t)) >= 80 * len(g):
                out.add((d, i))
    return out


def test_equals_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog while seven wizards quietly boil purple soup for the king of nowhere today".split()
    docs = [(1, " ".join(["pre"] * 500 + base + ["post"] * 3000)), (2, " ".join(base[:12])), (3, " ".join(base[:10] + ["X"] + base[11:])), (4, " ".join(base[:3] + ["x"] + base[4:])), (5, None), (6, ""), (7, "tiny item"), (8, "a tiny item here"), (None, " ".join(base)), (9, " ".join(base).upper()), (9, " ".join(base))]
    items = [(1, " ".join(base)), (2, "Tiny item"), (3, ""), (4, None), (None, "tiny item"), (5, " ".join(base[:5])), (6, " ".join(["a"] * 40))]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, item_id int, h int")
    of = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = decontam.contained(df, of).collect()
    assert len(got) == len({(r["doc_id"], r["item_id"]) for r in got})
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute(docs, items)
    left = decontam.decontaminate(df, of)
    assert left.columns == df.columns
    held = {d for d, _ in brute(docs, items)}
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(d) for d, _ in docs if d not in held)


def test_shuffled_paths(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", -1)
    test_equals_brute_force(spark)


def test_long_items_by_part_of_their_hashes(spark):
    """Items of up to 3,000 shingles, of which signatures hold some 32 to 64, in documents of up to 20,000."""
    rng = random.Random(9)
    word = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    items = [(i, word(n)) for i, n in enumerate([70, 90, 130, 300, 900, 3000] * 5)]
    docs = []
    for i, w in items:
        for share in (0.7, 0.79, 0.82, 0.9, 1.0):
            begin = w[: int(len(w) * share)]
            docs.append((len(docs), " ".join(word(rng.randrange(2000)) + begin + word(rng.randrange(18000)))))
    want = brute(docs, [(i, " ".join(w)) for i, w in items])
    got = decontam.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) >= 80


def test_odd_rows(odd_documents, no_documents, spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta eps")], "item_id long, text string")
    assert decontam.decontaminate(odd_documents, items).count() >= 8
    assert decontam.contained(no_documents, items).count() == 0
    assert decontam.contained(odd_documents, items.limit(0)).count() == 0
