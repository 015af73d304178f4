import hashlib
import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from sluice.llm import lines, queries
from sluice.llm.sql import ORACLE_SQL

SF = "/root/testdata/sf0.001"


def run(spark, rows, passage=50):
    df = spark.createDataFrame([(i, t, "x", 9) for i, t in rows], "doc_id long, text string, chunk string, n int")
    out = lines.dedup_lines(df, passage=passage)
    assert out.columns[:3] == ["doc_id", "chunk", "n"]
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"], r["n_lines"], r["n_removed"]) for r in out.collect() if r["text"] is not None)


def test_shared_passage_goes_where_it_is_not_first(spark):
    passage = [f"a shared line number {i} of the passage" for i in range(30)]
    rows = [(k, "\n".join([f"own {k} {j}" for j in range(k)] + passage + [f"end {k}"])) for k in range(1, 5)]
    got = run(spark, rows)
    assert got[0][1] == rows[0][1] and got[0][3] == 0
    for (k, text, n, removed), (_, whole) in zip(got[1:], rows[1:]):
        assert n == whole.count("\n") + 1 and removed == 30
        assert f"own {k} 0" in text and f"end {k}" in text
        left = text.split("\n") if text else []
        assert [x for x in whole.split("\n") if x in left] == left and len(left) == n - removed


def test_single_lines_and_blank_chunks_stay(spark):
    rows = [(1, "same"), (2, "same"), (3, "\n\n\n\n\n\n"), (4, "\n\n\n\n\n\n"), (5, ""), (6, "one\n"), (6, "one\n"), (None, "one\n")]
    got = run(spark, rows)
    assert [t for _, t, _, _ in got if t in ("same", "\n\n\n\n\n\n", "")] == ["same", "same", "\n\n\n\n\n\n", "\n\n\n\n\n\n", ""]


def test_copies_of_a_document(spark):
    text = "\n".join(f"line {i}" for i in range(40))
    got = run(spark, [(k, text) for k in range(50)])
    assert got[0][1:] == (text, 40, 0)
    assert len({g[1:] for g in got[1:]}) == 1 and got[1][3] > 20


def test_short_passages_go_whatever_surrounds_them(spark):
    for n in (1, 2, 3, 4, 6):
        passage = [" ".join(f"w{n}x{i}x{j}" for j in range(60 // n + 1 if n > 1 else 60)) for i in range(n)]
        if n == 4:
            passage.insert(2, "")
        rows = [(k, "\n".join([f"own {n} {k} {j}" for j in range(k % 5)] + passage + [f"end {n} {k} {j}" for j in range(k % 3)])) for k in range(1, 21)]
        for (k, text, _, removed), (_, whole) in zip(run(spark, rows), rows):
            assert removed == (0 if k == 1 else len(passage)), (n, k)
            assert text == "\n".join(x for x in whole.split("\n") if k == 1 or x not in passage)


def brute(docs, passage=50):
    """What is left by chunks between boundaries, with Python's dicts."""
    ink = re.compile(r"[^\x20\x09-\x0D]")
    number = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:8], 16)
    texts = {k: t.split("\n") for k, t in docs}
    full = {k: [j for j, x in enumerate(ls) if ink.search(x)] for k, ls in texts.items()}
    pairs = {k: [(texts[k][a], texts[k][b]) for a, b in zip(f, f[1:])] for k, f in full.items()}
    times = Counter(p for ps in pairs.values() for p in ps)
    found, per = {}, {}
    for k in sorted(texts):
        f = full[k]
        v = {q: (number(a) * 31 + number(b)) % 4294967291 for q, (a, b) in enumerate(pairs[k]) if times[a, b] > 1}
        least = {q for q in v if all(q + d in v and v[q] < v[q + d] for d in (-1, 1)) and all(q + d not in v or v[q] < v[q + d] for d in (-2, 2))}
        per[k], q = [], 0
        kept = sorted(set(v) - least)
        while q < len(kept):
            to = q
            while to + 1 < len(kept) and kept[to + 1] == kept[to] + 1:
                to += 1
            end = kept[to] + 1
            per[k].append((f[kept[q]], f[end + 1] - 1 if end in least else f[end]))
            q = to + 1
        per[k] += [(j, j) for j in f if passage and len(re.findall(r"[^\x20\x09-\x0D]+", texts[k][j])) >= passage]
        for a, b in per[k]:
            chunk = "\n".join(texts[k][a : b + 1])
            found[chunk] = min(found.get(chunk, (k, a)), (k, a))
    out = {}
    for k, ls in texts.items():
        gone = {j for a, b in per[k] if found["\n".join(ls[a : b + 1])] != (k, a) for j in range(a, b + 1)}
        out[k] = (len(ls), len(gone), "\n".join(x for j, x in enumerate(ls) if j not in gone))
    return out


def test_chunks_go_whole_and_one_of_each_stays_whole(spark):
    rows = [(1, "A\nB"), (2, "A\nB\nC"), (3, "B\nC\nD")]
    assert [(t, n) for _, t, _, n in run(spark, rows, None)] == [("A\nB", 0), ("A\nB\nC", 0), ("B\nC\nD", 0)]
    rows = [(1, "x\nA\nB\ny"), (2, "A\nB\nC"), (3, "A\nB\nC"), (4, "A\nB")]
    assert [t for _, t, _, _ in run(spark, rows, None)] == ["x\nA\nB\ny", "A\nB\nC", "", ""]


def test_a_change_in_one_line_keeps_the_chunks_around_it(spark):
    body = [f"line {i} of a long text" for i in range(200)]
    edited = [[f"edit {k}" if i == 20 * k else x for i, x in enumerate(body)] for k in range(1, 9)]
    rows = [(0, "\n".join(body))] + [(k + 1, "\n".join(e)) for k, e in enumerate(edited)]
    got = run(spark, rows, None)
    assert got[0][3] == 0 and all(n >= 180 for _, _, _, n in got[1:])
    shifted = [(0, "\n".join(body)), (1, "\n".join(["new first line", *body[:77], "inserted", *body[77:]]))]
    assert run(spark, shifted, None)[1][3] >= 190


def test_recall_on_planted_passages(spark):
    rng = random.Random(12)
    passages = [[f"passage {p} line {i} {rng.random()}" for i in range(2 + p % 5)] for p in range(40)]
    rows, planted = [], 0
    for k in range(400):
        own = [f"own {k} {j} {rng.random()}" for j in range(rng.randint(2, 8))]
        at = rng.randint(0, len(own))
        rows.append((k, "\n".join([*own[:at], *passages[k % 40], *own[at:]])))
        planted += len(passages[k % 40]) if k >= 40 else 0
    got = run(spark, rows, None)
    assert all(n == 0 for k, _, _, n in got if k < 40)
    assert sum(n for _, _, _, n in got) >= 0.99 * planted and all(n <= len(passages[k % 40]) for k, _, _, n in got)


def test_random_texts_equal_brute_force(spark):
    rng = random.Random(13)
    few = [f"l{i}" for i in range(14)] + ["", " "]
    rows = [(k, "\n".join(rng.choices(few, k=rng.randint(1, 40)))) for k in range(150)]
    assert {k: (n, r, t) for k, t, n, r in run(spark, rows, None)} == brute(rows, None)


def test_table_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op7_lines(spark, SF).collect()} == brute(docs)
    # Nothing is lost altogether: a removed line is left in some document.
    left = {x for _, _, t in brute(docs).values() for x in t.split("\n")}
    assert {x for _, t in docs for x in t.split("\n") if x.strip()} <= left


def test_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(map(tuple, queries.op7_lines(spark, SF).collect())) == sorted(con.execute(ORACLE_SQL["op7_lines"]).fetchall())


def test_order_of_lines_counts(spark):
    rows = [(1, "first line\nsecond line"), (2, "second line\nfirst line"), (3, "x\nfirst line\nsecond line")]
    assert [(k, n) for k, _, _, n in run(spark, rows)] == [(1, 0), (2, 0), (3, 2)]
    hashes = spark.createDataFrame([("a", "b")], "x string, y string").select(lines.rolled(F.col("x"), F.col("y")), lines.rolled(F.col("y"), F.col("x"))).first()
    assert hashes[0] != hashes[1]


def test_hot_window_and_many_places(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT_PLACES", 20)
    rows = [(k, f"own {k}\nhot one\nhot two\nend {k}\nwarm {k % 40}\nwarm too") for k in range(300)]
    got = {k: (n, r, t) for k, t, n, r in run(spark, rows)}
    assert got == brute(rows)


def test_clashing_names(spark):
    text = "one line here\nand a second one"
    df = spark.createDataFrame([(1, text, 7, 8, "g", 5, "w", 3), (2, text, 9, 10, "h", 6, "v", 4)], "doc_id long, text string, _k1 int, k1 int, _gone string, N_Lines int, whole string, c0 int")
    out = lines.dedup_lines(df)
    assert out.columns == ["doc_id", "_k1", "k1", "_gone", "whole", "c0", "text", "n_lines", "n_removed"]
    assert sorted(map(tuple, out.collect())) == [(1, 7, 8, "g", "w", 3, text, 2, 0), (2, 9, 10, "h", "v", 4, "", 2, 2)]


def test_odd_rows(odd_documents, no_documents):
    out = lines.dedup_lines(odd_documents)
    assert out.count() == odd_documents.count() and out.where("text IS NULL").count() == odd_documents.where("text IS NULL").count()
    assert lines.dedup_lines(no_documents).count() == 0
