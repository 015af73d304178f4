import random

import public_tokenizers
import sentencepiece

from sluice.llm import tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_counts_equal_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(3)
    parts = [*" \n\t▁abcdeh.0é漢😀\x00\u3000\u200b", "the", "ing", "<s>", "</s>", "<unk>", "<0x0A>", "  ", "▁▁"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(3000)] + ["", None, "ab" * 20000, " " * 500]
    got = tokens.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()
    for r in got:
        text = texts[r["doc_id"]] or ""
        assert r["n_tokens"] == len(library.encode(text)) and r["n_bytes"] == len(text.encode())


def test_table_equals_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r["doc_id"]: len(library.encode(r["text"])) for r in docs.select("doc_id", "text").collect()}
    assert dict(tokens.count_tokens(docs, PATH).select("doc_id", "n_tokens").collect()) == want


def test_memory_of_units_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_UNITS", 10)
    m = tokens.PieceMerger(PATH)
    m.count(" ".join(f"w{i}" for i in range(100)))
    assert len(m.known) <= 10


def test_odd_rows(odd_documents, no_documents):
    assert tokens.count_tokens(odd_documents, PATH).count() == odd_documents.count()
    assert tokens.count_tokens(no_documents, PATH).count() == 0
