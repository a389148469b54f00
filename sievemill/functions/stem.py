"""Porter's suffix stripping (1980), applied to distinct words and joined back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The suffixes of steps 2 to 4 in the published order.
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """v for vowels, c for consonants; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short_end(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _swap(word: str, rules: list[tuple[str, str]], least: int) -> str:
    found = max((r for r in rules if word.endswith(r[0])), key=lambda r: len(r[0]), default=None)
    if found and _measure(word[: -len(found[0])]) > least:
        return word[: -len(found[0])] + found[1]
    return word


def porter(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in _shape(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _STEP2, 0), _STEP3, 0)
    end = max((e for e in _STEP4 if word.endswith(e)), key=len, default=None)
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def stem_lists(df: DataFrame, columns: list[str], held: int = 200_000) -> DataFrame:
    """`df` with every word of some array columns stemmed, in Arrow batches; a task remembers the stems of `held` words."""

    def run(batches):
        known: dict[str, str] = {}

        def stem(word):
            if word is None:
                return None
            if word not in known:
                if len(known) >= held:
                    known.clear()
                known[word] = porter(word)
            return known[word]

        for batch in batches:
            yield batch.assign(**{c: [None if x is None else [stem(w) for w in x] for x in batch[c]] for c in columns})

    return df.mapInPandas(run, df.schema)


def stem_column(words: DataFrame, column: str) -> DataFrame:
    """`words` with `column` stemmed: each distinct word once, joined back."""

    def run(batches):
        for batch in batches:
            yield batch.assign(stem=[porter(w) if w is not None else None for w in batch["w"]])

    known = words.select(F.col(column).alias("w")).distinct().mapInPandas(run, "w string, stem string")
    out = words.join(known, words[column].eqNullSafe(known["w"]), "left")
    return out.select(*[F.col("stem").alias(column) if c == column else words[c] for c in words.columns])
