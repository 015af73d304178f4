import hashlib
import random
import re

from pyspark.sql import functions as F

from sluice.llm import pii


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c)
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def brute(text):
    text = text or ""
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text) if ok(m.group(0))] for k, (p, ok) in kinds.items()}


TEXTS = [
    None, "", "none", "é😀 a.b+c@d-e.f.g,h@i.j x@y @z.w a@b.c+d@e.f a@b@c.d", "1.2.3.4.5.6.7.8 300.1.1.1 0255.1.1.1 1.2.3 9.9.9.9",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 5 x 4111  111111111111111", "12 34 4111111111111111", "4785380592391139$$$ 2123465659789240",
    "+1 (743) 555-3824 +12 +123456789012345678 ++49 30 123456-7. +1.", "9" * 20000 + " " + "a" * 20000 + "@b.c", "1" * 16, "😀" * 50 + "me@x.org\n+4930 1234567",
    "a." * 9000 + "@" + "b." * 9000 + "c", "1.1." * 3000,
]


def test_base_kinds_equal_brute_force(spark):
    rows = list(enumerate(TEXTS))
    found = pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in found:
        for kind, spans in brute(TEXTS[r["doc_id"]]).items():
            assert [(x["start"], x["end"]) for x in r[kind]] == spans, (r["doc_id"], kind)


def test_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    names = [k.name for k in pii.BASE]
    got = dict(pii.detect(docs).select("doc_id", F.sha2(pii.written(names), 256)).collect())
    for k, text in texts.items():
        want = ",".join(f"{kind}:{a}:{b}" for kind, spans in brute(text).items() for a, b in spans)
        assert got[k] == hashlib.sha256(want.encode()).hexdigest()


def test_checksums_and_context_decide_added_kinds(spark):
    rows = [
        (1, "IBAN DE89 3704 0044 0532 0130 00 please"), (2, "code DE89 3704 0044 0532 0130 01 here"), (3, "GB82WEST12345698765432"),
        (4, "my amex card 378282246310005 ok"), (5, "number 378282246310005 ok"), (6, "SSN: 123-45-6789"), (7, "part 123-45-6789"),
    ]
    got = {r["doc_id"]: r for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [len(got[i]["iban"]) for i in (1, 2, 3)] == [1, 0, 1]
    assert [len(got[i]["shortcard"]) for i in (4, 5)] == [1, 0]
    assert [len(got[i]["ssn"]) for i in (6, 7)] == [1, 0]


def test_account_numbers_end_where_their_country_says(spark):
    nl, de = "NL91 ABNA 0417 1643 00", "DE89370400440532013000"
    rows = [
        (1, f"IBAN {nl} BIC ABNANL2A"), (2, f"{de} {nl} 2024"), (3, "PAY TO GB82 WEST 1234 5698 7654 32 REF 77 NOW"), (4, f"AB12 CODE 0000 1111 {nl} TOTAL 12"),
        (5, f"{de}A"), (6, "NL91 ABNA 0417 1643 01 BIC ABNANL2A"), (7, f"DE12 3456 {nl} X"), (8, f"{nl}00"), (9, "NO93 8601 1117 947 KONTO"),
    ]
    got = {r["doc_id"]: [dict(rows)[r["doc_id"]][x["start"] : x["end"]] for x in r["iban"]] for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [nl], 2: [de, nl], 3: ["GB82 WEST 1234 5698 7654 32"], 4: [nl], 5: [], 6: [], 7: [nl], 8: [], 9: ["NO93 8601 1117 947"]}


def added(text):
    """Spans of the added kinds by Python's own arithmetic."""
    lengths = {c: n for n, countries in pii.IBAN_LENGTHS.items() for c in countries.split()}
    near = lambda a, b, words: any(w in (text[max(0, a - 48) : a] + " " + text[b : b + 48]).lower() for w in words)
    found = {"iban": [], "shortcard": [], "ssn": []}
    for m in re.finditer(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?: ?[A-Z0-9]){11})", text):
        n = lengths.get(m.group()[:2])
        got = re.match(rf"(?:[A-Z0-9] ?){{{n - 1}}}[A-Z0-9](?![A-Za-z0-9])" if n else r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", text[m.start() : m.start() + 68])
        if got:
            plain, end = got.group().replace(" ", ""), m.start() + got.end()
            holds = int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
            score = 2 + 4 * holds + 3 * near(m.start(), end, ("iban", "account", "konto", "compte", "cuenta", "bank"))
            if score >= 6 and (not found["iban"] or found["iban"][-1][1] <= m.start()):
                found["iban"].append((m.start(), end))
    for m in re.finditer(r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,14}(?![ -]?[0-9])", text):
        if luhn(re.sub("[^0-9]", "", m.group())) and near(*m.span(), ("card", "visa", "amex", "credit", "karte", "carte", "tarjeta")):
            found["shortcard"].append(m.span())
    for m in re.finditer(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", text):
        if not re.search("^(?:000|666|9)|-00-|-0000$", m.group()) and near(*m.span(), ("ssn", "social security", "taxpayer")):
            found["ssn"].append(m.span())
    return found


def test_added_kinds_equal_brute_force(spark):
    rng = random.Random(8)

    def account():
        country, n = rng.choice([("NL", 18), ("DE", 22), ("GB", 22), ("NO", 15), ("FR", 27), ("XX", 20)])
        body = "".join(rng.choice("0123456789" if rng.random() < 0.8 else "ABCDEFGHIJ") for _ in range(n - 4))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country) + "00") % 97 + rng.choice([0, 0, 0, 1])
        whole = f"{country}{check:02d}{body}"
        return whole if rng.random() < 0.5 else " ".join(whole[i : i + 4] for i in range(0, n, 4))

    def card():
        digits = "".join(rng.choice("0123456789") for _ in range(rng.choice([12, 13, 14])))
        digits += next(c for c in "0123456789" if luhn(digits + c)) if rng.random() < 0.8 else "7"
        return digits if rng.random() < 0.5 else digits[:4] + "-" + digits[4:10] + " " + digits[10:]

    ssn = lambda: f"{rng.choice([0, 123, 666, 900, 555]):03d}-{rng.choice([0, 45]):02d}-{rng.choice([0, 6789]):04d}"
    words = ["IBAN", "bank", "Account", "card", "VISA", "ssn", "taxpayer", "BIC", "ABNANL2A", "plain", "é😀", "words", "\n", "12", "and so on, at length, with nothing near to it,"]
    texts = [rng.choice([" ", "", "-"]).join(rng.choice([account, card, ssn])() if rng.random() < 0.35 else rng.choice(words) for _ in range(14)) if i % 4 == 0 else " ".join(rng.choice([account, card, ssn])() if rng.random() < 0.35 else rng.choice(words) for _ in range(14)) for i in range(600)]
    total = 0
    for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        for kind, spans in added(texts[r["doc_id"]]).items():
            assert [(x["start"], x["end"]) for x in r[kind]] == spans, (texts[r["doc_id"]], kind)
            total += len(spans)
    assert total > 400


def test_odd_rows(odd_documents, no_documents):
    assert pii.detect(odd_documents).count() == odd_documents.count()
    assert pii.detect(no_documents).count() == 0


def test_key_of_a_clashing_name(spark):
    df = spark.createDataFrame([("mail a@b.nl", 7, "x")], "text string, _text long, t string")
    assert [(r["_text"], len(r["email"])) for r in pii.detect(df, key="_text").collect()] == [(7, 1)]
