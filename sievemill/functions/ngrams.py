"""N-grams and term combinations of word arrays, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once a row: an expression inside a lambda is computed for every item."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _of_words(grams: Callable[..., Column]) -> Callable[..., Column]:
    """Grams of words that are computed once, whatever expression gives them."""

    @wraps(grams)
    def run(words: Column, *args, **named) -> Column:
        return once(words, lambda w: grams(w, *args, **named))

    return run


def unigrams(words: Column) -> Column:
    """The words themselves."""
    return words


def _runs(words: Column, n: int, join: str) -> Column:
    """Every n adjacent words, joined."""
    places = F.sequence(F.lit(1), F.size(words) - (n - 1))
    return F.transform(places, lambda i: F.array_join(F.slice(words, i, n), join))


def _skips(words: Column, n: int, join: str, skip: int) -> Column:
    """Every n words of which each follows the one before by at most `skip` others."""
    steps = F.array(*[F.lit(k) for k in range(1, skip + 2)])

    def grow(done: Column, place: Column, left: int) -> Column:
        if not left:
            return F.array(done)
        return F.flatten(F.transform(steps, lambda k: F.when(place + k <= F.size(words), grow(F.concat(done, F.lit(join), F.element_at(words, (place + k).cast("int"))), place + k, left - 1)).otherwise(F.array().cast("array<string>"))))

    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: grow(F.element_at(words, i.cast("int")), i, n - 1)))


@_of_words
def bigrams(words: Column, join: str = "_", skip: int = 0) -> Column:
    """Pairs; a list of one word or none is itself."""
    made = _skips(words, 2, join, skip) if skip else _runs(words, 2, join)
    return F.when(F.size(words) > 1, made).otherwise(words)


@_of_words
def trigrams(words: Column, join: str = "_", skip: int = 0) -> Column:
    """Triples; a list of two words or fewer gives its bigrams."""
    made = _skips(words, 3, join, skip) if skip else _runs(words, 3, join)
    return F.when(F.size(words) > 2, made).otherwise(bigrams(words, join, skip))


@_of_words
def fourgrams(words: Column, join: str = "_") -> Column:
    """Runs of four; a list of three words or fewer gives its trigrams."""
    return F.when(F.size(words) > 3, _runs(words, 4, join)).otherwise(trigrams(words, join))


@_of_words
def biterms(words: Column, join: str = "_") -> Column:
    """All pairs in order of place; a list of one word or none is itself."""
    n = F.size(words)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.slice(words, i + 1, n), lambda w: F.concat(F.element_at(words, i), F.lit(join), w)))
    return F.when(n > 1, F.flatten(pairs)).otherwise(words)


@_of_words
def triterms(words: Column, join: str = "_") -> Column:
    """All triples in order of place; a list of two words or fewer gives its biterms."""
    n = F.size(words)

    def after(i: Column) -> Column:
        return F.flatten(F.transform(F.sequence(i + 1, n - 1), lambda j: F.transform(F.slice(words, j + 1, n), lambda w: F.concat(F.element_at(words, i), F.lit(join), F.element_at(words, j), F.lit(join), w))))

    return F.when(n > 2, F.flatten(F.transform(F.sequence(F.lit(1), n - 2), after))).otherwise(biterms(words, join))


def cooccurrences(a: Column, b: Column, join: str = "X") -> Column:
    """Each term of a with each of b."""
    return once(b, lambda own: F.flatten(F.transform(a, lambda x: F.transform(own, lambda y: F.concat(x, F.lit(join), y)))))


def cooccurrence_text(a: Column, b: Column, join: str = "X", between: str = " ") -> Column:
    """Each term of a with each of b, joined: b's terms are joined once for each of a, so that no pair has a string of its own."""

    def pairs(own: Column) -> Column:
        line = lambda x: F.concat(x, F.lit(join), F.call_function("array_join", own, F.concat(F.lit(between), x, F.lit(join))))
        return F.when(F.size(own) > 0, F.array_join(F.transform(a, line), between)).when(own.isNotNull() & a.isNotNull(), F.lit(""))

    return once(F.filter(b, lambda y: y.isNotNull()), pairs)


GRAMS = {"unigram": unigrams, "bigram": bigrams, "trigram": trigrams}
