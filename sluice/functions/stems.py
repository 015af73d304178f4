"""Word forms as Columns: English and Dutch suffixes stripped by ordered rules over regions of a word.

English follows Porter's rules (1980), Dutch the Snowball rules for Dutch of the same kind; a word that English leaves as it
is goes through Dutch.  A rule is a suffix, what must hold of what is before it, and what takes its place; of the rules of
a step the one of the longest suffix that fits is taken, and no other is tried where its condition fails.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.values import _once

Body = Callable[[Column], Column]


def _chain(word: Column, *steps: Body) -> Column:
    """Steps one after the other, each over a value that is computed once."""
    for step in steps:
        word = _once(word, step)
    return word


def _ends(word: Column, suffix: str) -> Column:
    return word.endswith(suffix)


def _without(word: Column, n: int) -> Column:
    return F.substr(word, F.lit(1), F.length(word) - n)


def _longest(word: Column, rules: list[tuple[str, Body]]) -> Column:
    """The rule of the longest suffix that the word ends in decides; without any it stays."""
    out = None
    for suffix, then in sorted(rules, key=lambda r: -len(r[0])):
        out = F.when(_ends(word, suffix), then(word)) if out is None else out.when(_ends(word, suffix), then(word))
    return out.otherwise(word)


def _strip(suffix: str, condition: Callable[[Column], Column], instead: str = "") -> tuple[str, Body]:
    def then(word: Column) -> Column:
        stem = _without(word, len(suffix))
        return F.when(condition(stem), F.concat(stem, F.lit(instead)) if instead else stem).otherwise(word)

    return suffix, then


# English.  A y that is a consonant is written Y.

_V, _C = "[aeiouy]", "[^aeiouy]"
_any = lambda stem: stem.rlike(_V)
_one_up = lambda stem: stem.rlike(f"^{_C}*{_V}+{_C}")
_two_up = lambda stem: stem.rlike(f"^{_C}*{_V}+{_C}+{_V}+{_C}")
_just_one = lambda stem: stem.rlike(f"^{_C}*{_V}+{_C}+{_V}*$")
_short_end = lambda stem: stem.rlike(f"{_C}{_V}[^aeiouywxY]$")
_always = lambda stem: F.lit(True)

#: Suffixes of the second, third and fourth step and what takes their place (fixed values of the published rules).
SECOND = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _past(word: Column) -> Column:
    """Step 1b: "eed", or "ed" and "ing" with what they leave behind made whole."""

    def whole(stem: Column) -> Column:
        doubled = stem.rlike(f"({_C})\\1$") & ~stem.rlike("[lsz]$")
        return (
            F.when(stem.rlike("(?:at|bl|iz)$"), F.concat(stem, F.lit("e")))
            .when(doubled, _without(stem, 1))
            .when(_just_one(stem) & _short_end(stem), F.concat(stem, F.lit("e")))
            .otherwise(stem)
        )

    cut = lambda n: lambda w: F.when(_any(_without(w, n)), _once(_without(w, n), whole)).otherwise(w)
    return _longest(word, [_strip("eed", _one_up, "ee"), ("ed", cut(2)), ("ing", cut(3))])


def _last_e(word: Column) -> Column:
    stem = _without(word, 1)
    return F.when(_ends(word, "e") & (_two_up(stem) | (_just_one(stem) & ~_short_end(stem))), stem).otherwise(word)


def english(word: Column) -> Column:
    """The stem of a lower-case word of the letters a to z; any other word, and one of two letters, stays."""
    marked = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), "([aeiou])y", "$1Y")
    fourth = [_strip(s, _two_up) for s in FOURTH] + [_strip("ion", lambda stem: _two_up(stem) & stem.rlike("[st]$"))]
    stem = _chain(
        marked,
        lambda w: _longest(w, [_strip("sses", _always, "ss"), _strip("ies", _always, "i"), ("ss", lambda x: x), _strip("s", _always)]),
        _past,
        lambda w: F.when(w.rlike("[yY]$") & _any(_without(w, 1)), F.concat(_without(w, 1), F.lit("i"))).otherwise(w),
        lambda w: _longest(w, [_strip(s, _one_up, to) for s, to in SECOND.items()]),
        lambda w: _longest(w, [_strip(s, _one_up, to) for s, to in THIRD.items()]),
        lambda w: _longest(w, fourth),
        _last_e,
        lambda w: F.when(_ends(w, "ll") & _two_up(_without(w, 1)), _without(w, 1)).otherwise(w),
    )
    return F.when(word.rlike("^[a-z]{3,}$"), F.lower(stem)).otherwise(word)


# Dutch.  A y or i that is a consonant is written as a capital; R1 and R2 begin behind the marks in "one" and "two".

_DV = "[aeiouyè]"
_DC = "[^aeiouyè]"


def _single(word: Column) -> Column:
    return F.when(word.rlike("(?:kk|dd|tt)$"), _without(word, 1)).otherwise(word)


def _in(word: Column, n: int, mark: Column) -> Column:
    """Whether the last ``n`` letters lie in the region behind a mark."""
    return F.length(word) - n >= mark


def _no_en(word: Column, n: int, s: Column) -> Column:
    """The word less its last ``n`` letters, "en" or "ene", where they may go."""
    stem = _without(word, n)
    return F.when(_in(word, n, s["one"]) & stem.rlike(f"{_DC}$") & ~_ends(stem, "gem"), _single(stem)).otherwise(word)


def _no_e(word: Column, s: Column) -> Column:
    stem = _without(word, 1)
    return F.when(_ends(word, "e") & _in(word, 1, s["one"]) & stem.rlike(f"{_DC}$"), _single(stem)).otherwise(word)


def _no_ig(word: Column, s: Column, otherwise: Column) -> Column:
    stem = _without(word, 2)
    return F.when(_ends(word, "ig") & _in(word, 2, s["two"]) & ~_ends(stem, "e"), stem).otherwise(otherwise)


def dutch(word: Column) -> Column:
    """The stem of a lower-case word; accents go from vowels, but for è."""
    plain = F.translate(word, "äëïöüáéíóú", "aeiouaeiou")
    marked = _chain(plain, lambda w: F.regexp_replace(w, "^y", "Y"), lambda w: F.regexp_replace(w, f"({_DV})y", "$1Y"), lambda w: F.regexp_replace(w, f"(?<={_DV})i(?={_DV})", "I"))

    def stemmed(w: Column) -> Column:
        first, second = (F.regexp_extract(w, p, 0) for p in (f"^{_DC}*{_DV}+{_DC}", f"^{_DC}*{_DV}+{_DC}+{_DV}+{_DC}"))
        mark = lambda found: F.when(found == "", F.length(w) + 1).otherwise(F.length(found))
        return _chain(F.struct(w.alias("w"), F.greatest(mark(first), F.lit(3)).alias("one"), mark(second).alias("two"), F.lit(False).alias("e")), endings, last_e, heid, derived, vowels)

    def turned(s: Column, w: Column, e: Column | None = None) -> Column:
        return F.struct(w.alias("w"), s["one"].alias("one"), s["two"].alias("two"), (s["e"] if e is None else e).alias("e"))

    def endings(s: Column) -> Column:
        w = s["w"]
        no_s = lambda n: lambda x: F.when(_in(x, n, s["one"]) & _without(x, n).rlike(r"[^aeiouyèj]$"), _without(x, n)).otherwise(x)
        rules = [
            ("heden", lambda x: F.when(_in(x, 5, s["one"]), F.concat(_without(x, 5), F.lit("heid"))).otherwise(x)),
            ("en", lambda x: _no_en(x, 2, s)), ("ene", lambda x: _no_en(x, 3, s)), ("s", no_s(1)), ("se", no_s(2)),
        ]
        return turned(s, _longest(w, rules))

    def last_e(s: Column) -> Column:
        return _once(_no_e(s["w"], s), lambda w: turned(s, w, w != s["w"]))

    def heid(s: Column) -> Column:
        w, stem = s["w"], _without(s["w"], 4)
        goes = _ends(w, "heid") & _in(w, 4, s["two"]) & ~_ends(stem, "c")
        return turned(s, F.when(goes, F.when(_ends(stem, "en"), _no_en(stem, 2, s)).otherwise(stem)).otherwise(w))

    def derived(s: Column) -> Column:
        two = lambda n: lambda then: lambda x: F.when(_in(x, n, s["two"]), then(_without(x, n))).otherwise(x)
        bare = lambda stem: _once(stem, lambda x: _no_ig(x, s, _single(x)))
        rules = [
            ("end", two(3)(bare)), ("ing", two(3)(bare)), ("ig", lambda x: _no_ig(x, s, x)), ("lijk", two(4)(lambda stem: _no_e(stem, s))),
            ("baar", two(4)(lambda stem: stem)), ("bar", lambda x: F.when(_in(x, 3, s["two"]) & s["e"], _without(x, 3)).otherwise(x)),
        ]
        return turned(s, _longest(s["w"], rules))

    def vowels(s: Column) -> Column:
        return F.regexp_replace(s["w"], f"({_DC})([aeou])\\2([^aeiouyèI])$", "$1$2$3")

    return F.lower(_once(marked, stemmed))


def stem(word: Column) -> Column:
    """English rules, and Dutch ones where they change nothing."""
    return _once(word, lambda w: _once(english(w), lambda e: F.when(e != w, e).otherwise(dutch(w))))


def stemmed(text: Column) -> Column:
    """The words of a text (letters and digits) by their stems, lower-cased, one space apart; null for null."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), stem), " ")
