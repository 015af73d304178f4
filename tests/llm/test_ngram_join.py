import random

import numpy as np
import pytest

from sluice.llm import components, ngram_join
from tests.llm.test_pipeline import grams


def brute(docs):
    sets = {k: grams(t) for k, t in docs}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(k for k in sets if sets[k])
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {(k, len(s), root(k)) for k, s in sets.items()}


def chains(seed):
    """Families of texts that drift apart word by word, so that groups hold pairs far below the threshold."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs, k = [], 0
    for _ in range(6):
        text = rng.choices(words, k=rng.randint(20, 90))
        for _ in range(rng.randint(1, 25)):
            docs.append((k, " ".join(text)))
            k += rng.randint(1, 3)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.2:
                text = text + rng.choices(words, k=4)
    shared = " ".join(rng.choices(words, k=12))
    docs += [(1000 + i, shared + " " + " ".join(rng.choices(words, k=3 + i % 4))) for i in range(40)]
    docs += [(2000, None), (2001, ""), (2002, "a b"), (2003, "A b"), (2004, "a b c d"), (2005, "a b c d e"), (2006, " a\tb\nc d  e ")]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs = chains(seed)
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in docs], "doc_id long, text string, id int, component int").repartition(4)
    got = [tuple(r) for r in ngram_join.link(df).collect()]
    assert len(got) == len(docs) and set(got) == brute(docs)


def test_shuffled_paths(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", -1)
    test_equals_brute_force(spark, 3)


def test_odd_rows(odd_documents, no_documents):
    got = ngram_join.link(odd_documents).collect()
    assert len(got) == odd_documents.count()
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    assert ngram_join.link(no_documents).count() == 0
    assert ngram_join.distinct_documents(no_documents).count() == 0


def test_components_of_a_long_path(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(500, 501), (7, 7), (501, 500)], "a long, b long")
    got = {r["id"]: r["component"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {500: 500, 501: 500}


@pytest.mark.parametrize(("documents", "broadcast"), [(3, 0), (3, 10), (30, 500_000), (10**6, 0)])
def test_frequent_shingles_by_any_join(spark, monkeypatch, documents, broadcast):
    """Counters that many shingles share, few or all of them frequent, whether the table of frequent ones is broadcast or not."""
    monkeypatch.setattr(ngram_join, "HOT_DOCUMENTS", documents)
    monkeypatch.setattr(ngram_join, "HOT_TIMES", 0)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", broadcast)
    docs = chains(5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in ngram_join.link(df).collect()} == brute(docs)


def test_near_misses_are_filtered_and_links_are_not():
    """Pairs of 400 shingles: no link is lost, and of pairs of a family at some 0.72 few reach their texts."""
    rng = np.random.default_rng(4)

    def passed(common):
        total, one, two = np.full(300, 800), [], []
        for _ in total:
            own = rng.integers(0, 2**63, 800 - common, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            one.append(np.sort(own[:400])), two.append(np.sort(np.r_[own[: common], own[400:]]))
        profiles = [ngram_join._profile(np.concatenate(s), np.repeat(np.arange(300), 400), 300) for s in (one, two)]
        return ngram_join._suffix_filter(*profiles, total).mean()

    assert passed(356) == 1.0 and passed(400) == 1.0  # 356 of 444 is a link
    assert passed(335) < 0.3  # 335 of 465 is none


def test_profiles_of_empty_sets():
    got = ngram_join._profile(np.array([5, 2**63], np.uint64), np.array([1, 1]), 3)
    assert got.shape == (3, ngram_join.WIDTH) and not got[[0, 2]].any() and got[1, : ngram_join.RANGES].sum() == 2 == np.bitwise_count(got[1, ngram_join.RANGES :]).sum()
    assert ngram_join._profile(np.empty(0, np.uint64), np.empty(0, np.int64), 2).shape == (2, ngram_join.WIDTH)
