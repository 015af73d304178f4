"""Stems against plain readings of the published rules, and against words whose stems are known."""

import re

from pyspark.sql import functions as F

from sluice.functions import stems

ENGLISH = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky",
    "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit", "vietnamization": "vietnam", "operator": "oper", "hopefulness": "hope", "triplicate": "triplic", "electrical": "electr", "goodness": "good",
    "revival": "reviv", "allowance": "allow", "adjustment": "adjust", "adoption": "adopt", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "engineers": "engin", "is": "is",
}
DUTCH = {
    "lichaamsziek": "lichaamsziek", "lichamelijk": "licham", "lichamelijke": "licham", "lichamelijkheden": "licham", "lichamen": "licham", "lichten": "licht", "lichter": "lichter", "opgingen": "opging", "opglanzing": "opglanz",
    "opglanzingen": "opglanz", "opglimlachten": "opglimlacht", "opglimpen": "opglimp", "opglimpende": "opglimp", "opglimpingen": "opglimp", "opgraven": "opgrav", "opgrijnzen": "opgrijnz", "opgroeien": "opgroei", "opgroeiende": "opgroei",
    "opheffen": "opheff", "opheffing": "opheff", "brood": "brod", "maan": "man", "groepen": "groep", "één": "een", "katten": "kat", "huisje": "huisj", "huisjes": "huisjes", "vrijheid": "vrijheid", "opdrachten": "opdracht", "functies": "functies",
}


def each(spark, f, words):
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(4)
    return dict(df.select("w", f(F.col("w")).alias("s")).collect())




def kinds(w):
    found = []
    for i, c in enumerate(w):
        found.append(c in "aeiou" or (c == "y" and i > 0 and not found[i - 1]))
    return "".join("v" if k else "c" for k in found)


def measure(w):
    return len(re.findall("v+c+", kinds(w)))


def porter(w):
    if not re.fullmatch("[a-z]{3,}", w):
        return w
    short = lambda s: kinds(s)[-3:] == "cvc" and s[-1] not in "wxy"

    def first(w, table, least):
        for s in sorted(table, key=len, reverse=True):
            if w.endswith(s):
                stem = w[: -len(s)]
                return stem + table[s] if measure(stem) > least else w
        return w

    for s, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(s):
            w = w[: -len(s)] + to
            break
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) else w
    else:
        for s in ("ed", "ing"):
            if w.endswith(s):
                if "v" in kinds(w[: -len(s)]):
                    w = w[: -len(s)]
                    if w[-2:] in ("at", "bl", "iz"):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and kinds(w)[-1] == "c" and w[-1] not in "lsz":
                        w = w[:-1]
                    elif measure(w) == 1 and short(w):
                        w += "e"
                break
    if w.endswith("y") and "v" in kinds(w[:-1]):
        w = w[:-1] + "i"
    w = first(first(w, stems.SECOND, 0), stems.THIRD, 0)
    for s in sorted((*stems.FOURTH, "ion"), key=len, reverse=True):
        if w.endswith(s):
            stem = w[: -len(s)]
            if measure(stem) > 1 and (s != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


def snowball(w):
    v = set("aeiouyè")
    w = list(w.translate(str.maketrans("äëïöüáéíóú", "aeiouaeiou")))
    if w and w[0] == "y":
        w[0] = "Y"
    for i in range(1, len(w)):
        if w[i] == "y" and w[i - 1] in v:
            w[i] = "Y"
    for i in range(1, len(w) - 1):
        if w[i] == "i" and w[i - 1] in v and w[i + 1] in v:
            w[i] = "I"
    w = "".join(w)

    def past(i):
        while i < len(w) and w[i] not in v:
            i += 1
        while i < len(w) and w[i] in v:
            i += 1
        return i + 1 if i < len(w) else len(w) + 1

    p1 = past(0)
    p2 = past(p1) if p1 <= len(w) else len(w) + 1
    p1 = max(p1, 3)
    single = lambda s: s[:-1] if s[-2:] in ("kk", "dd", "tt") else s

    def no_en(w, n):
        s = w[:-n]
        return single(s) if len(s) >= p1 and s and s[-1] not in v and not s.endswith("gem") else w

    def no_e(w):
        s = w[:-1]
        return single(s) if w.endswith("e") and len(s) >= p1 and s[-1] not in v else w

    for e in ("heden", "ene", "en", "se", "s"):
        if w.endswith(e):
            s = w[: -len(e)]
            if e == "heden":
                w = s + "heid" if len(s) >= p1 else w
            elif e[0] == "e":
                w = no_en(w, len(e))
            elif len(s) >= p1 and s and s[-1] not in v and s[-1] != "j":
                w = s
            break
    before, w = w, no_e(w)
    e_gone = before != w
    if w.endswith("heid") and len(w) - 4 >= p2 and not w.endswith("cheid"):
        w = w[:-4]
        if w.endswith("en"):
            w = no_en(w, 2)
    ig = lambda s: s.endswith("ig") and len(s) - 2 >= p2 and not s.endswith("eig")
    for e in ("lijk", "baar", "end", "ing", "bar", "ig"):
        if w.endswith(e):
            s = w[: -len(e)]
            if e == "ig":
                w = s if ig(w) else w
            elif len(s) >= p2:
                if e in ("end", "ing"):
                    w = s[:-2] if ig(s) else single(s)
                elif e == "lijk":
                    w = no_e(s)
                elif e == "baar" or e_gone:
                    w = s
            break
    if len(w) >= 4 and w[-4] not in v and w[-3] == w[-2] and w[-3] in "aeou" and w[-1] not in v and w[-1] != "I":
        w = w[:-2] + w[-1]
    return w.lower()


def test_known_words(spark):
    got = each(spark, stems.english, list(ENGLISH))
    assert {w: (got[w], s) for w, s in ENGLISH.items() if got[w] != s} == {}
    got = each(spark, stems.dutch, list(DUTCH))
    assert {w: (got[w], s) for w, s in DUTCH.items() if got[w] != s} == {}


def test_all_words_of_the_table(spark):
    text = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = [r["w"] for r in text.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("w")).distinct().collect()]
    base = ["y", "yy", "ayy", "byy", "toyed", "yyen", "gemen", "iien", "aiai", "bijen", "ooien", "geig", "eigheid", "wacheid", "fonkelend", "kraakbare", "kraakbaar", "draagbar", "teennageltje", *DUTCH, *ENGLISH]
    words = sorted({*words, *base})[:: max(1, len(words) // 15_000)] + base
    got = each(spark, stems.english, words)
    assert [(w, got[w], porter(w)) for w in words if got[w] != porter(w)] == []
    got = each(spark, stems.dutch, words)
    assert [(w, got[w], snowball(w)) for w in words if got[w] != snowball(w)] == []


def test_texts_meet_in_their_stems(spark):
    df = spark.createDataFrame([("Java-engineers, opdrachten!", "java engineer opdracht"), ("De huizen; groepen", "de HUIZEN groep"), (None, None), ("", "")], "a string, b string")
    assert all(r["x"] == r["y"] for r in df.select(stems.stemmed(F.col("a")).alias("x"), stems.stemmed(F.col("b")).alias("y")).collect())


def test_stored_documents_are_found_by_any_form(spark, tmp_path):
    from datetime import datetime, timezone

    from sluice.operators import search

    rows = [(1, "Java-engineers gezocht", "voor opdrachten in huizen", "active"), (2, "Engineering", "een groep", "active"), (3, "Engineer", None, "closed")]
    docs = spark.createDataFrame(rows, "id long, title string, text string, status string").withColumns({"closing": F.lit(None).cast("timestamp"), "last_seen": F.lit("2024-01-01").cast("timestamp")})
    search.store(docs, str(tmp_path / "s"), datetime(2024, 1, 2, tzinfo=timezone.utc), searched=("title", "text"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    found = lambda words, name="all": sorted(r["id"] for r in search.scope(stored, name).where(search.forms(words, F.col("stems"))).collect())
    assert found("engineer") == [1, 2, 3] and found("engineered", "active") == [1, 2] and found("groepen") == [2] and found("java engineer") == [1] and found("opdracht") == [1] and found("gin") == []
    assert [r["id"] for r in stored.where(search.term("JAVA-eng", F.col("haystack"))).collect()] == [1]
