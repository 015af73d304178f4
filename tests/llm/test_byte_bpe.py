import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from sluice.llm import byte_bpe, queries

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(byte_bpe.read_ranks(PATH), PATTERN)


def test_ids_equal_the_library(codec, library):
    rng = random.Random(4)
    tokens = [t.decode(errors="ignore") for t in library.token_byte_values()]
    table = byte_bpe.token_bytes(byte_bpe.read_ranks(PATH))
    wide = [*"  \n\t\r\x00\x1c\x85\xa0 　éß漢字😀'sſ١²ǅ", "'ll", "<|endoftext|>", "�"]
    for _ in range(4000):
        text = "".join(rng.choice(tokens) if rng.random() < 0.6 else rng.choice(wide) for _ in range(rng.randint(0, 15)))
        ids = codec.encode(text)
        assert list(ids) == library.encode_ordinary(text)
        assert b"".join(table[list(ids)]) == text.encode()
    for text in ("x" * 30_000, " " * 30_001, "ab" * 20_000, "aaab" * 9000, "漢" * 9000, "0123456789" * 3000):
        assert list(codec.encode(text)) == library.encode_ordinary(text)


def test_own_vocabularies_with_tokens_that_merges_never_make():
    rng = random.Random(5)
    for _ in range(60):
        letters = [b"a", b"b", b"c"]
        ranks = {bytes([b]): b for b in range(256)}
        for _ in range(rng.randint(1, 25)):
            ranks.setdefault(b"".join(rng.choices(letters, k=rng.randint(2, 6))), len(ranks))
        own = byte_bpe.Codec(ranks, r"\w+|\W+")
        library = tiktoken.Encoding("own", pat_str=r"\w+|\W+", mergeable_ranks=ranks, special_tokens={})
        for _ in range(80):
            text = "".join(rng.choices("abc ", weights=[4, 4, 4, 1], k=rng.randint(0, 60)))
            assert list(own.encode(text)) == library.encode_ordinary(text)


def test_memory_is_bounded(monkeypatch, library):
    for name in ("KEPT_PIECES", "KEPT_PAIRS"):
        monkeypatch.setattr(byte_bpe, name, 20)
    own = byte_bpe.Codec(byte_bpe.read_ranks(PATH), PATTERN)
    text = " ".join(f"word{i * 7919}qx" for i in range(500))
    assert list(own.encode(text)) == library.encode_ordinary(text)
    assert len(own.known) <= 20 and len(own.pairs) <= 20


def test_a_vocabulary_without_all_bytes_is_refused():
    with pytest.raises(ValueError):
        byte_bpe.Codec({b"a": 0}, PATTERN)


def test_query_equals_the_library(spark, library):
    digest = lambda b: hashlib.sha256(b).hexdigest()
    docs = dict(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect())
    rows = queries.op12_byte_bpe(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == digest(",".join(map(str, ids)).encode()) and r["decoded_sha256"] == digest(text.encode())


def test_odd_rows(spark, odd_documents, no_documents, library):
    found = byte_bpe.decode(byte_bpe.encode(odd_documents, PATH, PATTERN), PATH).collect()
    want = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, library.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()) for r in odd_documents.collect()))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, list(r["ids"]), bytes(r["decoded"])) for r in found) == want
    assert byte_bpe.decode(byte_bpe.encode(no_documents, PATH, PATTERN), PATH).count() == 0
    null = spark.createDataFrame([(1, None, "x"), (2, [], "y"), (3, [262, 65], "z")], "_row int, ids array<int>, decoded string")
    got = {r["_row"]: r["decoded"] for r in byte_bpe.decode(null, PATH).collect()}
    assert got[1] is None and bytes(got[2]) == b"" and bytes(got[3]) == library.decode_bytes([262, 65])


def test_bytes_that_are_no_utf8(spark):
    df = spark.sql("select 1L as doc_id, cast(unhex('61ff62') as string) as text")
    found = byte_bpe.decode(byte_bpe.encode(df, PATH, PATTERN), PATH).first()
    assert bytes(found["decoded"]).decode() == "a�b"
