import math
import random
from collections import defaultdict

import numpy as np

from sluice.llm import queries, whitening


def check(spark, rows, most=16, name="float"):
    """Against the definition: exact integers for the deviation, a library's eigenvalues for the rest."""
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{name}>, n int, k string")
    sound = [(r["vec_id"], tuple(math.floor(64 * x) + 1_000_000 for x in r["embedding"])) for r in df.collect() if r["embedding"] is not None and all(x is not None and math.isfinite(x) for x in r["embedding"])]
    fits = defaultdict(set)
    for _, x in sound:
        fits[len(x)].add(x)
    got = whitening.whiten(df, most).collect()
    seen = defaultdict(list)
    for r in got:
        seen[r["vec_id"]].append(r)
    want_rows = 0
    for dim, vectors in fits.items():
        n, total = len(vectors), [sum(c) for c in zip(*vectors)]
        if not dim:
            continue
        centred = np.array([[(n * a - b) / n for a, b in zip(x, total)] for x in vectors])
        values = np.linalg.eigvalsh(centred.T @ centred / n)[::-1]
        kept = [e for e in values if e > 1e-9 * max(values[0], 1e-300)][:most] if n > 1 else []
        own = [(i, x) for i, x in sound if len(x) == dim]
        want_rows += len(own) * len(kept)
        table = {}
        for i, x in own:
            rows_of = [r for r in seen[i] if r["n"] == n and r["deviation"] == min(2**63 - 1, sum((n * a - b) ** 2 for a, b in zip(x, total)))]
            assert {r["component"] for r in rows_of} == set(range(1, len(kept) + 1))
            for r in rows_of:
                table.setdefault(x, {})[r["component"]] = r["whitened"]
                assert math.isclose(r["explained"], kept[r["component"] - 1] / values.sum(), rel_tol=1e-9)
                assert r["identity_error"] <= 1e-9
        if kept:
            z = np.array([[table[x][c] for c in range(1, len(kept) + 1)] for x in vectors])
            assert np.abs(z.T @ z / n - np.eye(len(kept))).max() < 1e-8
            # The variance of x along a component is its eigenvalue.
            back = np.linalg.lstsq(z, centred, rcond=None)[0]
            assert np.allclose((back**2).sum(1), kept, rtol=1e-7)
    assert len(got) == want_rows
    return got


def test_equals_the_definition(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 3.0 ** -(j % 5)) + rng.gauss(0, 1) * (j == 2) for j in range(20)]) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(30)]
    check(spark, rows)
    check(spark, rows, most=3)


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1), rng.gauss(0, 2)]) for i in range(50)]
    rows += [(100, None), (101, [1.0, None]), (102, [float("nan"), 1.0]), (103, [float("inf"), 1.0]), (104, [])]
    rows += [(200 + i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(4)]  # rank 3 of 5
    rows += [(300, [1.0, 2.0, 3.0])]  # alone of its dimension
    rows += [(0, rows[0][1])] * 2  # repeated rows
    got = check(spark, rows)
    assert {r["component"] for r in got if r["vec_id"] in range(200, 204)} == {1, 2, 3}
    assert sum(r["vec_id"] == 0 for r in got) == 6
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [0.5])] * 3, "vec_id long, embedding array<float>")).count() == 0
    assert whitening.whiten(spark.createDataFrame([(None, [0.5]), (2, [0.75])], "vec_id long, embedding array<float>")).count() == 2


def test_large_components(spark):
    check(spark, [(i, [2.0**40 * (i % 7) + i, 3.0 * i, -(2.0**38) * (i % 3)]) for i in range(40)], name="double")


def test_many_dimensions_are_fitted_in_groups(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MOST_NUMBERS", 10)
    rng = random.Random(3)
    check(spark, [(i, [rng.gauss(0, 1) for _ in range(1 + i % 4)]) for i in range(120)])


def test_factor_and_rotation():
    rng = np.random.default_rng(4)
    for rank in (0, 1, 5, 12):
        m = rng.normal(size=(40, rank)) @ rng.normal(size=(rank, 12)) if rank else np.zeros((40, 12))
        a = m.T @ m
        f = whitening.pivoted_cholesky(a)
        assert f.shape == (12, rank) and np.allclose(f @ f.T, a)
        values, axes = whitening.components(a)
        assert np.allclose(axes.T @ axes, np.eye(rank)) and np.allclose(a @ axes, axes * values)
    graded = np.diag(10.0 ** -np.arange(0, 14, 2.0))
    q = np.linalg.qr(rng.normal(size=(7, 7)))[0]
    values, _ = whitening.components(graded)
    assert np.allclose(values, np.diag(graded), rtol=1e-14)
    values, _ = whitening.components(q @ graded @ q.T)
    assert np.allclose(values[:3], np.diag(graded)[:3], rtol=1e-8)


def test_query_equals_the_definition(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = {tuple(r) for r in check(spark, rows)}
    got = queries.op11_whitening(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(want) and {(r["vec_id"], r["component"], r["deviation"]) for r in got} == {(r[0], r[1], r[3]) for r in want}
