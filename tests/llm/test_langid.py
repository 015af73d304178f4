import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sluice.llm import langid


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(0)
    m = langid.fresh(["a", "b", "c"])
    for name in ("inputs", "turns", "shift"):
        setattr(m, name, [w.astype(np.float64) for w in getattr(m, name)])
    m.out, m.bias = m.out.astype(np.float64), m.bias.astype(np.float64)
    x, mask, y = rng.integers(0, 256, (6, 5)).astype(np.uint8), np.ones((6, 5), np.float32), rng.integers(0, 3, 5)
    mask[4:, 2] = 0
    _, grads = langid.loss_and_gradient(m, x, mask, y)
    for w, g in zip(m.weights(), grads):
        i, e = np.unravel_index(np.argmax(np.abs(g)), g.shape), 1e-3
        at = w[i]
        w[i] = at + e
        up = langid.loss_and_gradient(m, x, mask, y)[0]
        w[i] = at - e
        down = langid.loss_and_gradient(m, x, mask, y)[0]
        w[i] = at
        assert abs((up - down) / 2 / e - g[i]) < 2e-3 * max(1, abs(g[i]))


def slow(m, text):
    """Pooled probabilities, position by position."""
    data, parts = text.encode(), []
    for at in range(0, len(data), langid.SPAN):
        x = np.frombuffer(data[at : at + langid.SPAN], np.uint8)[:, None]
        hf, _ = langid._learn_direction(m.inputs[0], m.turns[0], m.shift[0], x, np.ones(x.shape))
        hb, _ = langid._learn_direction(m.inputs[1], m.turns[1], m.shift[1], x[::-1], np.ones(x.shape))
        logits = m.out @ np.concatenate([hf, hb[::-1]], axis=1) + m.bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        parts.append((p / p.sum(1, keepdims=True))[:, :, 0])
    return np.concatenate(parts).mean(0)


def test_runner_equals_position_by_position():
    m = langid.fresh(["a", "b", "c"])
    texts = ["x" * 64, "héllo wörld, " * 128, "ab" * 320, "short", "ü" * 33, "é" * 700 + "x", "a"]
    got = langid.Runner(m).pooled(pa.array(texts))
    for row, t in zip(got, texts):
        assert np.allclose(row, slow(m, t), atol=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97


def test_short_texts(spark):
    """Pieces of held-out documents of 30 to 60 characters."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = docs.where(langid.held_out(F.col("doc_id")) & (F.length("text") > 400)).select("doc_id", "lang", F.expr("substr(text, 200, 30 + doc_id % 30)").alias("text"))
    got = langid.predict(pieces, langid.fit(docs)).join(pieces.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.85


def test_many_languages(spark):
    rows = [(i, "some words here", f"l{i % 300}") for i in range(1500)]
    _, labels = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(labels) == {f"l{i % 300}" for i in range(1500) if zlib.crc32(str(i).encode()) % 3 != 1}


def test_short_texts_are_asked_for_less():
    asked = langid.required(0.7, 4, np.array([0.0, 16, 128, 1000, 1e6]))
    assert asked[0] == 0.25 and all(asked[:-1] < asked[1:]) and 0.699 < asked[-1] < 0.7 and abs(asked[2] - 0.475) < 1e-9
    assert set(langid.required(0.0, 1, np.array([1.0, 5.0]))) == {0.0}


def test_held_out_rows_teach_nothing(spark):
    rows = [(i, "aaaa bbbb " * 20, "x" if zlib.crc32(str(i).encode()) % 3 != 1 else "never") for i in range(60)]
    windows, labels = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(labels) == {"x"} and len(windows) <= langid.SAMPLE_DOCUMENTS * langid.WINDOWS


def test_odd_rows(odd_documents, no_documents, spark):
    model = langid.fit(odd_documents)
    got = langid.predict(odd_documents, model)
    assert got.count() == odd_documents.count()
    assert got.where("lang_pred = 'und'").select(F.max("score")).first()[0] == 0
    assert langid.predict(no_documents, model).count() == 0
    none = langid.fit(no_documents)
    assert {r["lang_pred"] for r in langid.predict(odd_documents, none).collect()} == {"und"}
    assert sorted(map(repr, langid.accepted(odd_documents, none, 0.3).collect())) == sorted(map(repr, odd_documents.collect()))
    assert langid.accepted(no_documents, model, 0.3).count() == 0
    kept = langid.accepted(odd_documents, model, 0.0)
    assert kept.columns == odd_documents.columns and kept.where("text IS NULL OR NOT text RLIKE '[a-zA-Zü漢]'").count() == 0
    twice = odd_documents.unionAll(odd_documents).withColumn("_has_letter", F.lit(3)).withColumn("T", F.lit(None).cast("string"))
    assert langid.accepted(twice, model, 0.0).count() == 2 * kept.count()
