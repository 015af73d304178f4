import math
import random

from sluice.llm import topk


def brute(rows, k, every):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for qi, q in ok:
        if qi % every == 0:
            scores = sorted(((-sum(a * b for a, b in zip(q, c)), ci) for ci, c in ok if ci != qi and len(c) == len(q)))[:k]
            out |= {(qi, r + 1, ci, -s) for r, (s, ci) in enumerate(scores)}
    return out


def check(spark, rows, k=20, every=20):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, rank string")
    got = [tuple(r) for r in topk.top_k(df, k, every).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, k, every)


def test_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [round(rng.gauss(0, 1) * 2 ** (j == 0), 3) for j in range(8)]) for i in range(1500)]
    check(spark, rows)


def test_ties_and_odd_rows(spark):
    same = [0.5] * 4
    rows = [(i, same) for i in range(60)] + [(100, None), (120, [1.0, None, 1.0, 1.0]), (140, [1.0, float("nan"), 1.0, 1.0]), (160, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(None, same), (180, [1.0, 2.0]), (181, [3.0, -1.0]), (200, [0.0] * 4), (220, [-1e5] * 4), (221, [2.0**33, 1.0, 1.0, 1.0]), (240, [])]
    check(spark, rows)
    check(spark, rows[:5])


def test_empty(spark):
    check(spark, [])


def test_large_components_and_scores(spark):
    # Scores near 2^55 that differ by less than doubles can tell.
    top = [(20, [2.0**23, 0.0]), *((i, [2.0**20, 0.0]) for i in range(1, 20)), *((i, [2.0**20, i / 2.0**24]) for i in range(21, 32))]
    check(spark, top)


def test_scores_beyond_a_long_are_held_at_its_ends(spark):
    rows = [(i, [1e11 * (i % 3 - 1), 1e10]) for i in range(25)] + [(40, [1e300, -1e300]), (41, [-1e300, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    most = 2**63 - 1
    hold = lambda x: max(-most, min(most, x))
    ok = [(i, [hold(math.floor(64 * x)) for x in v]) for i, v in rows]
    want = set()
    for qi, q in ok:
        if qi % 20 == 0:
            best = sorted((-hold(sum(a * b for a, b in zip(q, c))), ci) for ci, c in ok if ci != qi)[:20]
            want |= {(qi, r + 1, ci, -s) for r, (s, ci) in enumerate(best)}
    assert {tuple(r) for r in topk.top_k(df).collect()} == want


def test_many_blocks_and_repeated_rows(spark, monkeypatch):
    for name, n in (("LEAST_BLOCK", 40), ("MOST_BLOCK", 60), ("QUERY_BLOCK", 8), ("SEEDS", 30)):
        monkeypatch.setattr(topk, name, n)
    rng = random.Random(4)
    rows = [(i, [round(rng.gauss(0, 1) * 3 ** (i % 4), 3) for _ in range(6)]) for i in range(900)]
    check(spark, rows, k=7, every=3)
    same = [(i, [0.5, -0.25, 1.0]) for i in range(300)]
    check(spark, same, k=5, every=7)
    twice = [(i, [float(i % 7), 1.0]) for i in range(60)] * 2  # equal rows: candidates count twice, queries ask once
    df = spark.createDataFrame(twice, "vec_id long, embedding array<float>")
    got = topk.top_k(df, 6, 20).collect()
    per = {}
    for r in got:
        per.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q, hits in per.items():
        want = sorted(((-(64 * 64 * ((q % 7) * (i % 7) + 1)), i) for i, _ in twice if i != q))[:6]
        assert [(v, -s) for _, v, s in sorted(hits)] == [(i, s) for s, i in want]
    assert set(per) == {0, 20, 40}
