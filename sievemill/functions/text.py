"""Text columns: cleaning, tokens, word filters.  Everything here stays in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ngrams import once

TOKEN = r"[\p{L}\p{N}_]{2,}"

# Rewrite rules of the relevance corpus, in the order in which they apply; keys are regular expressions.
REPLACEMENTS = [
    ("nutri system", "nutrisystem"),
    ("soda stream", "sodastream"),
    ("playstation's", "ps"),
    ("playstations", "ps"),
    ("playstation", "ps"),
    ("(ps 2)", "ps2"),
    ("(ps 3)", "ps3"),
    ("(ps 4)", "ps4"),
    ("ps 2", "ps2"),
    ("ps 3", "ps3"),
    ("ps 4", "ps4"),
    ("coffeemaker", "coffee maker"),
    ("k-cups", "k cup"),
    ("k-cup", "k cup"),
    ("4-ounce", "4 ounce"),
    ("8-ounce", "8 ounce"),
    ("12-ounce", "12 ounce"),
    ("ounce", "oz"),
    ("button-down", "button down"),
    ("doctor who", "dr who"),
    ("2-drawer", "2 drawer"),
    ("3-drawer", "3 drawer"),
    ("in-drawer", "in drawer"),
    ("hardisk", "hard drive"),
    ("hard disk", "hard drive"),
    ("harley-davidson", "harley davidson"),
    ("harleydavidson", "harley davidson"),
    ("e-reader", "ereader"),
    ("levi strauss", "levi"),
    ("levis", "levi"),
    ("mac book", "macbook"),
    ("micro-usb", "micro usb"),
    ("screen protector for samsung", "screen protector samsung"),
    ("video games", "videogames"),
    ("game pad", "gamepad"),
    ("western digital", "wd"),
    ("eau de toilette", "perfume"),
]
# Storage sizes whose unit is joined to the number.
GIGABYTES, TERABYTES = (16, 32, 64, 128, 500), (2,)


def unit_rules() -> list[tuple[str, str]]:
    """(pattern, replacement) that join a size and its unit, in order."""
    rules = [rule for n in GIGABYTES for rule in ((f"{n} gb", f"{n}gb"), (f"{n} g", f"{n}gb"), (f"{n}g ", f"{n}gb "))]
    return rules + [(f"{n} tb", f"{n}tb") for n in TERABYTES]


def rewrite(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Apply regular-expression rules one after the other."""
    return reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1].replace("\\", "\\\\").replace("$", "\\$")), rules, text)


def drop_html(text: Column) -> Column:
    """Markup out, a space in its place."""
    return F.regexp_replace(text, "<[^>]*>", " ")


def replace_words(text: Column, words: dict[str, str]) -> Column:
    """Exact words between single spaces replaced once; `words` is a lookup table of bounded size."""
    if not words:
        return text
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return F.array_join(F.transform(F.split(text, " ", -1), lambda w: F.coalesce(table[w], w)), " ")


def clean_text(text: Column, *, html: bool = False, synonyms: dict[str, str] | None = None, rules: list[tuple[str, str]] | None = None) -> Column:
    """Null to empty, markup (if asked), lower case, units, rewrite rules, synonyms."""
    text = F.coalesce(text, F.lit(""))
    text = F.lower(drop_html(text) if html else text)
    return replace_words(rewrite(text, unit_rules() + (REPLACEMENTS if rules is None else rules)), synonyms or {})


def replace_negations(words: Column, antonyms: dict[str, str], sign: str = "not") -> Column:
    """`not x` becomes x's antonym where `antonyms` has exactly one; other words stay.

    Each word is judged by its neighbours, unless the sign is itself a word or an
    antonym in the table: then by what came out before it, in time that grows
    with the square of the list.
    """
    if not antonyms:
        return words
    table = F.create_map(*[F.lit(x) for pair in antonyms.items() for x in pair])
    if sign not in antonyms and sign not in antonyms.values():

        def judged(own: Column) -> Column:
            before, after = (lambda i: F.get(own, i - 1)), (lambda i: F.get(own, i + 1))
            turned = lambda w, i: F.when((before(i) == sign) & table[w].isNotNull(), table[w]).otherwise(w)
            gone = lambda w, i: F.coalesce((w == sign) & table[after(i)].isNotNull(), F.lit(False))
            marked = F.transform(own, lambda w, i: F.struct(turned(w, i).alias("w"), gone(w, i).alias("gone")))
            return F.transform(F.filter(marked, lambda x: ~x["gone"]), lambda x: x["w"])

        return once(words, judged)

    def step(state: Column, w: Column) -> Column:
        last = F.element_at(state, -1)
        turned = (F.size(state) > 0) & (last == sign) & table[w].isNotNull()
        return F.when(turned, F.concat(F.slice(state, F.lit(1), F.size(state) - 1), F.array(table[w]))).otherwise(F.concat(state, F.array(w)))

    return F.aggregate(words, F.array().cast("array<string>"), step)


def tokens(text: Column) -> Column:
    """Lower-cased runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def without(words: Column, stop: list[str]) -> Column:
    """`words` that aren't in a stop list of bounded size."""
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def count_digits(words: Column) -> Column:
    """Words of digits only."""
    return F.size(F.filter(words, lambda w: w.rlike(r"^\p{Nd}+$"))).cast("long")


_PLAIN = [("àáâãäå", "a"), ("ç", "c"), ("èéêë", "e"), ("ìíîï", "i"), ("ñ", "n"), ("òóôõö", "o"), ("ùúûü", "u"), ("ýÿ", "y")]
_FROM = "".join(a for a, _ in _PLAIN) + "".join(a for a, _ in _PLAIN if a != "ýÿ").upper() + "Ý"
_TO = "".join(b * len(a) for a, b in _PLAIN) + "".join(b * len(a) for a, b in _PLAIN if a != "ýÿ").upper() + "Y"


def strip_accents(text: Column) -> Column:
    """Latin-1 letters without their marks."""
    return F.translate(text, _FROM, _TO)


def all_text(*texts: Column) -> Column:
    """Texts joined by spaces, null as empty."""
    return F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts])


def is_pattern(text: str) -> bool:
    """Whether a rule's key means more than its letters."""
    return re.escape(text) != text.replace(" ", r"\ ").replace("-", r"\-")
