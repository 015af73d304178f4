"""Contract forms that running text offers or rules out, clause by clause, as Columns.

A sentence is written as a string of classes, one letter for each word or mark (:data:`CLASSES`), so that what a sentence
says about contract forms is a matter of short patterns over few letters: lists behind "geen" are found and masked first,
across their commas; refusals open a sentence; denials stay inside one clause.  What is left of a term, neither listed nor
denied beside it, is an offer.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.values import _lookup, _once, agreed_contract, contract_form

#: Words of Dutch postings by class (fixed values).
CLASSES = {
    "F": ("zzp", "zzp'er", "zzp'ers", "zzp’er", "zzp’ers", "freelance", "freelancer", "freelancers"),
    "D": ("detachering", "detacheren", "detavast", "deta-vast"),
    "V": ("vast dienstverband", "vaste aanstelling", "vast contract", "vaste baan", "permanent"),
    "I": ("interim",),
    "g": ("geen",),
    "d": ("niet toegestaan", "niet mogelijk", "niet geschikt", "niet gewenst", "niet welkom", "niet geaccepteerd", "uitgesloten"),
    "N": ("niet",),
    "j": ("of", "en"),
    "c": ("is", "zijn"),
    "w": ("wordt", "worden"),
    "z": ("staat", "staan"),
    "v": ("voor", "als"),
    "e": ("een",),
    "n": ("nee", "neen"),
    "k": ("mogelijk", "mogelijkheid"),
    "l": ("toegestaan",),
    "b": ("beschikbaar",),
    "t": ("gezocht", "gewenst", "welkom", "geaccepteerd"),
    "q": ("zonder", "met", "die", "welke"),
    "h": ("helaas", "jammer genoeg", "let op"),
    "s": ("opdracht", "functie", "rol", "vacature", "aanvraag", "positie", "inzet"),
    "a": ("deze", "dit", "de", "het"),
    "o": ("bedoeld", "bestemd", "open"),
    ",": (",",),
    ":": (":",),
}
#: Another name of freelance, which is only ever an offer (fixed value).
ALIAS = r"marktplaats\s*\(freelance\)"

_LETTER = r"[\p{L}\p{N}_]"
_LONG = sorted((w for words in CLASSES.values() for w in words if len(w.split()) > 1 or "'" in w or "’" in w or "-" in w), key=len, reverse=True)
#: A word, several words that stand for one thing, or a single mark.
_TOKEN = rf"{ALIAS}|(?:{'|'.join(w.replace(' ', chr(92) + 's+') for w in _LONG)})(?!{_LETTER})|{_LETTER}+|[^\s\p{{L}}\p{{N}}_]"
_SENTENCES = r"[.!?;\n]+"
#: A sentence without any of these says nothing about contract forms.
_SPEAKS = r"zzp|freelance|deta|vast|permanent|interim"

_ANY = "[FDVI]"
#: "geen" and one term, or a list of terms that "of" or "en" closes, confirmed by a word or by the end of the clause.
_LIST = rf"g{_ANY}(?:(?:,g?{_ANY})*jg?{_ANY})?(?:[cw]?[klbt]|(?=[,:]|$))"
_SUBJECT = r"(?:a?s[cz]|[cz]a?s),?"
_LEAD = r"(?:h[,:]?,?)?"
#: A refusal that opens its sentence, of no mere part of the freelancers.
_REFUSAL = rf"^{_LEAD}(?:{_SUBJECT})?,?{_LEAD}N[ob]?ve?F(?!q)"
#: Denials inside one clause: behind the term, before it, and as an answer.
_DENIED = (r"F:?[cw]?d(?!q)", r"d:?v?e?F(?!q)", r"F[kl]?:n")


def _class(token: Column) -> Column:
    plain = F.regexp_replace(token, r"\s+", " ")
    known = _lookup(plain, {word: letter for letter, words in CLASSES.items() for word in words})
    confirming = plain.rlike("^(?:" + "|".join(w for c in "klbt" for w in CLASSES[c]) + ")")
    return F.coalesce(known, F.when(plain.rlike(rf"^{ALIAS}$"), "A").when(confirming, "t").when(plain.rlike(rf"^{_LETTER}"), "x").otherwise("p"))


def classes(sentence: Column) -> Column:
    """A sentence as one letter for each of its words and marks; ``x`` is any other word, ``p`` any other mark."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(sentence), F.lit(_TOKEN), F.lit(0)), _class), "")


def _read(text: Column, body) -> Column:
    """``body(coded sentences)`` of those sentences that speak of contract forms."""
    spoken = F.filter(F.split(text, _SENTENCES), lambda s: F.lower(s).rlike(_SPEAKS))
    return _once(F.transform(spoken, classes), body)


def _ruled_out(coded: Column) -> Column:
    lists = F.regexp_extract_all(coded, F.lit(_LIST), F.lit(0))
    listed = F.exists(lists, lambda m: m.contains("F"))
    denied = F.exists(F.split(coded, ","), lambda clause: reduce(or_, [clause.rlike(p) for p in _DENIED]))
    return listed | coded.rlike(_REFUSAL) | denied


def _offers(coded: Column, term: str) -> Column:
    """Whether a term stands in a clause outside lists, with no denial right before or behind it."""
    open_ = rf"(?<![gd])(?<![gd]v){term}(?!(?::|k:)?[cw]?[nd])"
    return F.exists(F.split(F.regexp_replace(coded, _LIST, ""), ","), lambda clause: clause.rlike(open_))


def freelance_ruled_out(text: Column) -> Column:
    """Whether a text closes a posting to freelancers; null for null."""
    return _read(text, lambda sentences: F.exists(sentences, _ruled_out))


def contract_in_text(text: Column) -> Column:
    """``freelance``, ``detachering``, ``interim`` or ``vast``: the contract form that a text offers; null if it says none.

    Where freelance is ruled out, an offered ``detachering`` comes before ``vast`` before ``interim``.  Else ``vast`` must
    stand without ``detachering`` and freelance, freelance without ``detachering`` and ``interim``; of the others
    ``detachering`` comes first.
    """

    def chosen(sentences: Column) -> Column:
        said = lambda term: F.exists(sentences, lambda s: _offers(s, term))
        seen = F.struct(F.exists(sentences, _ruled_out).alias("out"), said("[FA]").alias("free"), said("D").alias("posted"), said("V").alias("fixed"), said("I").alias("interim"))
        return _once(seen, ladder)

    def ladder(f: Column) -> Column:
        left = F.when(f["posted"], "detachering").when(f["fixed"], "vast").when(f["interim"], "interim")
        open_ = (
            F.when(f["fixed"] & ~f["posted"] & ~f["free"], "vast")
            .when(f["free"] & ~f["posted"] & ~f["interim"], "freelance")
            .when(f["interim"] & ~f["posted"], "interim")
            .when(f["posted"], "detachering")
        )
        return F.when(f["out"], left).otherwise(open_)

    return _read(text, chosen)


def resolved_contract(token: Column, tokens: Column, text: Column) -> Column:
    """The contract form by what says it most directly: a source's own token, then a list that agrees, then the text."""
    return F.coalesce(contract_form(token), agreed_contract(tokens), contract_in_text(text))
