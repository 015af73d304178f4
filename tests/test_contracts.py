"""Contract forms by clause; sentences of our own for each rule."""

import pytest
from pyspark.sql import functions as F

from sluice.functions import contracts

OUT = [
    "Geen zzp mogelijk!", "geen freelancers", "Voor deze klus geen zzp’ers gezocht", "ZZP: niet mogelijk", "Zzp'ers worden niet geaccepteerd", "freelance is uitgesloten",
    "Uitgesloten: zzp", "Niet geschikt voor een freelancer", "zzp toegestaan: nee", "Inzet als zzp'er: niet toegestaan", "Niet voor zzp'ers", "Niet bestemd voor freelancers",
    "De rol is niet voor zzp'ers", "Helaas is deze vacature niet open voor zzp", "Let op, niet voor freelancers", "Jammer genoeg niet als zzp'er",
    "Deze aanvraag staat niet open voor zzp", "Deze rol is, helaas, niet voor zzp'ers", "geen zzp of freelance is mogelijk", "Geen interim, detachering of zzp toegestaan",
    "Geen interim of freelance", "geen zzp, geen detachering of interim", "Wij zoeken iemand\ngeen zzp",
]
OPEN = [
    "ZZP'ers met KvK zijn welkom", "Vergoeding van reizen geldt niet voor zzp'ers", "niet voor zzp'ers zonder diploma", "Zzp is niet toegestaan met een BV", "Geen ervaring met zzp nodig; freelance kan",
    "De bonus geldt voor werknemers, niet voor zzp'ers", "Geen detachering of interim. Zzp welkom", "geen zzp ervaring vereist", "ZZP ervaring: nee. Freelance mogelijk",
    "Geschikt voor zzp'ers", "marktplaats (freelance)", "Geen budget en freelance inzet kan", "Niet geschikt voor interim, maar wel zzp",
]
FORMS = [
    ("Geen detachering. Zzp welkom", "freelance"), ("Geen zzp, detachering mogelijk", "detachering"), ("geen zzp of detachering, alleen vast dienstverband", "vast"),
    ("Niet voor zzp'ers, wel interim", "interim"), ("Freelance of detachering", "detachering"), ("Zzp: nee. Vast contract niet mogelijk", None), ("zzp: nee, interim niet toegestaan", None),
    ("Vaste aanstelling", "vast"), ("deta-vast traject", "detachering"), ("Interim manager of freelance", "interim"), ("Permanent of interim", "vast"), ("Alleen inhuur", None),
    ("geen budget en detachering is mogelijk", "detachering"), ("Geen zzp of interim gezocht, wel een vast  dienstverband", "vast"), ("", None), (None, None), ("Detachering: nee", None),
    ("Geen detachering", None), ("Uitgesloten voor interim", None), ("geen interim-klus", None), ("interim-klus", "interim"), ("detacheringsbureau", None),
]


def each(spark, f, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_ruled_out(spark):
    got = each(spark, contracts.freelance_ruled_out, OUT + OPEN)
    assert [t for t, y in zip(OUT + OPEN, got) if y != (t in OUT)] == []


def test_forms(spark):
    got = each(spark, contracts.contract_in_text, [t for t, _ in FORMS])
    assert [(t, y) for (t, want), y in zip(FORMS, got) if y != want] == []


def test_open_texts_offer_freelance(spark):
    neither = ["Zzp is niet toegestaan met een BV", "geen zzp ervaring vereist"]  # not ruled out, but not offered
    assert each(spark, contracts.contract_in_text, neither) == [None, None]
    assert set(each(spark, contracts.contract_in_text, [t for t in OPEN if t not in neither])) == {"freelance"}


@pytest.mark.parametrize("title", ["Zzp adviseur", "Freelance rol"])
def test_a_title_is_a_sentence_of_its_own(spark, title):
    assert each(spark, contracts.contract_in_text, [f"{title}\nGeen detachering", f"{title}\nGeen zzp"]) == ["freelance", None]
