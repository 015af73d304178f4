import random

import pytest

#: Texts that any operator must take: null, empty, white space, one word, very long, without a space.
ODD = [None, "", " \n\t ", "one", "a b c d e " * 4000, "x" * 30000, "ünï çödé 漢字 😀 done", "\x00 \x0b\x0c end"]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Documents with nulls in any column, odd texts, repeated rows and extra columns of clashing names."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    rows = [(i, t, "en", "s1", 1, "k", 2.0) for i, t in enumerate(ODD)]
    rows += [(100 + i, " ".join(rng.choices(words, k=rng.randint(1, 60))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None]), None, None, None) for i in range(60)]
    rows += [rows[-1], rows[-1], (None, "a null key", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, k string, size double")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
