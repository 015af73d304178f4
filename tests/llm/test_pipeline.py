import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sluice.llm import langid, lines

SF = "/root/testdata/sf0.001"


def grams(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def near_brute(docs):
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
    return {k for k in sets if root(k) == k}


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, out[-1], SF)
        out.append(spark.createDataFrame(rows.collect(), rows.schema))
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_duplicates", "decontamination", "mixing"]
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_language_keeps_what_it_can_tell(stages):
    windows, labels = langid.sample(stages[0])
    model = langid.train(windows, labels)
    least = langid.threshold(model, windows, labels, corpus_pipeline.LEAST_SCORE)
    got = langid.predict(stages[0], model).collect()
    size = {k: len((t or "").encode()) for k, t in pairs(stages[0])}
    asked = lambda k: langid.required(least, len(model.langs), np.array([size[k]]))[0]
    want = {r["doc_id"] for r in got if r["lang_pred"] != "und" and r["score"] >= asked(r["doc_id"])}
    assert {k for k, _ in pairs(stages[1])} == want and len(want) > 0.97 * len(got)


def test_line_dedup_drops_no_document(stages):
    assert {k for k, _ in pairs(stages[1])} == {k for k, _ in pairs(stages[2])}
    want = dict(lines.dedup_lines(stages[1], passage=50).select("doc_id", "text").collect())
    assert dict(pairs(stages[2])) == want
    assert stages[2].where(F.length("text") != F.col("n_chars")).count() == 0


def test_one_of_each_group_stays(stages):
    assert {k for k, _ in pairs(stages[3])} == near_brute(pairs(stages[2]))


def test_no_benchmark_item_is_left(stages, spark):
    items = [grams(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {k for k, t in pairs(stages[3]) if any(i and 100 * len(i & grams(t)) >= 80 * len(i) for i in items)}
    assert {k for k, _ in pairs(stages[4])} == {k for k, _ in pairs(stages[3])} - held


def test_mix_takes_from_all_that_is_left(stages, spark):
    assert {r["doc_id"] for r in stages[5].collect()} == {k for k, _ in pairs(stages[4])}
    whole = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert whole == sorted(map(tuple, stages[5].collect()))


def through(spark, docs):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, out[-1], SF)
        out.append(spark.createDataFrame(rows.collect(), rows.schema))
    return out


def test_odd_rows_pass_every_stage(spark, odd_documents):
    clashing = odd_documents.withColumn("_gone", F.lit(1)).withColumn("_later", F.lit("x")).withColumn("_held", F.lit(2)).withColumn("taken", F.lit(3))
    out = through(spark, clashing)
    assert all(df.columns == clashing.columns for df in out[:-1])
    counts = [df.count() for df in out]
    assert counts[2] == counts[1] and counts[5] == counts[4] <= counts[3] <= counts[2]
    assert {(r["doc_id"], r["taken"] <= 3 * r["size"]) for r in out[5].collect()} == {(k, True) for k, in out[4].select("doc_id").collect()}


def test_no_labels_and_no_rows(spark, no_documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, docs, SF).count() == docs.count()
    assert [df.count() for df in through(spark, no_documents)] == [0] * 6


def test_mixing_takes_words_near_targets(stages):
    rows = stages[5].collect()
    assert rows and all(0 <= r["taken"] <= 3 * r["size"] and r["target"] >= 0 for r in rows)
    for size, target in {(r["source_size"], r["target"]) for r in rows}:
        of = [r for r in rows if (r["source_size"], r["target"]) == (size, target)]
        assert abs(sum(r["taken"] for r in of) - target) <= max(r["size"] for r in of) / 2 + 1
