"""Counting, intersection, position and distance features of several text fields."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import SET_METRICS, STATS, intersect_count, positions, safe_divide
from ..functions.ngrams import GRAMS
from ..functions.text import count_digits

FIELDS = ("query", "title", "description")
#: Words of a slice of rows that is measured at a time.
SLICE = 200_000


def with_grams(df: DataFrame, fields: tuple[str, ...] = FIELDS, suffix: str = "tokens") -> DataFrame:
    """Add <field>_<gram> arrays for word arrays <field>_<suffix>."""
    return df.withColumns({f"{f}_{g}": make(F.col(f"{f}_{suffix}")) for f in fields for g, make in GRAMS.items()})


def basic_counts(fields: tuple[str, ...] = FIELDS) -> dict[str, Column]:
    """Sizes, distinct sizes and ratios of every gram; digits; whether the last field has no words."""
    out: dict[str, Column] = {}
    for f in fields:
        for g in GRAMS:
            a = F.col(f"{f}_{g}")
            n, distinct = F.size(a).cast("long"), F.size(F.array_distinct(a)).cast("long")
            out |= {f"count_of_{f}_{g}": n, f"count_of_unique_{f}_{g}": distinct, f"ratio_of_unique_{f}_{g}": safe_divide(distinct, n)}
        digits, n = count_digits(F.col(f"{f}_unigram")), F.size(f"{f}_unigram")
        out |= {f"count_of_digit_in_{f}": digits, f"ratio_of_digit_in_{f}": safe_divide(digits, n)}
    out[f"{fields[-1]}_missing"] = (F.size(f"{fields[-1]}_unigram") == 0).cast("int")
    return out


def intersect_counts(fields: tuple[str, ...] = FIELDS) -> dict[str, Column]:
    """Grams of one field in another, over all grams of the first; and the cross ratios with the first field."""
    out: dict[str, Column] = {}
    for g in GRAMS:
        held = {(a, b): intersect_count(F.col(f"{a}_{g}"), F.col(f"{b}_{g}")) for a, b in permutations(fields, 2)}
        for (a, b), n in held.items():
            out |= {f"count_of_{a}_{g}_in_{b}": n, f"ratio_of_{a}_{g}_in_{b}": safe_divide(n, F.size(f"{a}_{g}"))}
        q = fields[0]
        for other in fields[1:]:
            out[f"{other}_{g}_in_{q}_div_{q}_{g}"] = safe_divide(held[other, q], F.size(f"{q}_{g}"))
            out[f"{other}_{g}_in_{q}_div_{q}_{g}_in_{other}"] = safe_divide(held[other, q], held[q, other])
    return out


def position_stats(df: DataFrame, fields: tuple[str, ...] = FIELDS, grams: tuple[str, ...] = tuple(GRAMS)) -> DataFrame:
    """Add min, mean, median, max and std of the places of shared grams, plain and over the number of grams."""
    pairs = [(g, target, obs) for g in grams for target, obs in permutations(fields, 2)]
    name = lambda g, target, obs: f"pos_of_{obs}_{g}_in_{target}"
    placed = df.withColumns({f"__{name(*p)}": positions(F.col(f"{p[1]}_{p[0]}"), F.col(f"{p[2]}_{p[0]}")) for p in pairs})
    stats: dict[str, Column] = {}
    for p in pairs:
        for s, make in STATS.items():
            x = make(F.col(f"__{name(*p)}"))
            stats |= {f"{name(*p)}_{s}": x, f"normalized_{name(*p)}_{s}": safe_divide(x, F.size(f"{p[2]}_{p[0]}"))}
    return placed.withColumns(stats).drop(*[f"__{name(*p)}" for p in pairs])


def distances(fields: tuple[str, ...] = FIELDS) -> dict[str, Column]:
    """Set similarities of each pair of fields for every gram."""
    pairs = [(a, b) for i, a in enumerate(fields) for b in fields[i + 1 :]]
    return {f"{m}_of_{g}_between_{a}_{b}": make(F.col(f"{a}_{g}"), F.col(f"{b}_{g}")) for m, make in SET_METRICS.items() for g in GRAMS for a, b in pairs}


def _grams(words: pa.Array, sizes: np.ndarray) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """(gram, the grams of all rows, their number by row) of rows of words; the same lists as GRAMS makes."""
    yield "unigram", words, sizes
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(words))  # words from here to the row's end
    size = np.repeat(sizes, sizes)
    for n, name in ((2, "bigram"), (3, "trigram")):
        at = np.flatnonzero(left >= np.minimum(size, n))  # a row of fewer words is one gram
        parts = [words.take(pa.array(np.minimum(at + k, len(words) - 1), mask=left[at] <= k)) for k in range(n)]
        yield name, pc.binary_join_element_wise(*parts, "_", null_handling="skip"), np.bincount(np.repeat(np.arange(len(sizes)), sizes)[at], minlength=len(sizes))


def _over(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.divide(x, y, out=np.zeros(len(x)), where=y != 0)


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are among some in order."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _measured(fields: tuple[str, ...], lists: list[pa.ListArray]) -> dict[str, np.ndarray]:
    """All counting features and set similarities of some rows, by name; each gram is looked up in the other fields by its place in one dictionary."""
    rows, out, held = len(lists[0]), {}, {}
    made = {f: _grams(x.flatten(), pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)) for f, x in zip(fields, lists, strict=True)}
    for g in GRAMS:
        grams = {f: next(made[f])[1:] for f in fields}
        coded = pa.concat_arrays([x.cast(pa.string()) for x, _ in grams.values()]).dictionary_encode()
        codes, digits = coded.indices.to_numpy().astype(np.int64), pc.utf8_is_decimal(coded.dictionary).to_numpy(zero_copy_only=False)
        n_codes, at, keys, known, place, owner, size = max(len(coded.dictionary), 1), 0, {}, {}, {}, {}, {}
        for f, (x, n) in grams.items():
            code, at = codes[at : at + len(x)], at + len(x)
            size[f], owner[f] = n, np.repeat(np.arange(rows), n)
            place[f] = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + 1
            keys[f] = owner[f] * n_codes + code
            known[f] = np.unique(keys[f])
            distinct = np.bincount(known[f] // n_codes, minlength=rows)
            held[f, g] = {f"count_of_{f}_{g}": n, f"count_of_unique_{f}_{g}": distinct, f"ratio_of_unique_{f}_{g}": _over(distinct, n)}
            if g == "unigram":
                k = np.bincount(owner[f][digits[code]], minlength=rows) if len(code) else np.zeros(rows, np.int64)
                held[f, "digit"] = {f"count_of_digit_in_{f}": k, f"ratio_of_digit_in_{f}": _over(k, n)}
                held["missing"] = {f"{f}_missing": (n == 0).astype(np.int32)}  # of the last field
        shared = {(a, b): _among(keys[a], known[b]) for a, b in permutations(fields, 2)}
        count = {(a, b): np.bincount(owner[a][x], minlength=rows) for (a, b), x in shared.items()}
        held["intersect", g], q = {}, fields[0]
        for (a, b), n in count.items():
            held["intersect", g] |= {f"count_of_{a}_{g}_in_{b}": n, f"ratio_of_{a}_{g}_in_{b}": _over(n, size[a])}
        for f in fields[1:]:
            held["intersect", g] |= {f"{f}_{g}_in_{q}_div_{q}_{g}": _over(count[f, q], size[q]), f"{f}_{g}_in_{q}_div_{q}_{g}_in_{f}": _over(count[f, q], count[q, f])}
        held["places", g] = {}
        for target, obs in permutations(fields, 2):
            x, own, n = place[obs][shared[obs, target]], owner[obs][shared[obs, target]], count[obs, target]
            first, some = np.cumsum(n) - n, n > 0
            nth = lambda i: np.where(some, x[np.where(some, first + i, 0)] if len(x) else 0, 0).astype(float)  # noqa: B023, E731
            mean = _over(np.bincount(own, x, rows), n)
            std = np.sqrt(_over(np.bincount(own, (x - mean[own]) ** 2, rows), n))
            stats = {"min": nth(0), "mean": mean, "median": (nth((n - 1) // 2) + nth(n // 2)) / 2, "max": nth(n - 1), "std": std}
            name = f"pos_of_{obs}_{g}_in_{target}"
            for s in STATS:
                held["places", g] |= {f"{name}_{s}": stats[s], f"normalized_{name}_{s}": _over(stats[s], size[obs])}
        for a, b in combinations(fields, 2):
            both = np.bincount(known[a][_among(known[a], known[b])] // n_codes, minlength=rows)
            whole = held[a, g][f"count_of_unique_{a}_{g}"] + held[b, g][f"count_of_unique_{b}_{g}"]
            held["jaccard_coef", g, a, b] = {f"jaccard_coef_of_{g}_between_{a}_{b}": _over(both, whole - both)}
            held["dice_dist", g, a, b] = {f"dice_dist_of_{g}_between_{a}_{b}": _over(2 * both, whole)}
    order = [k for f in fields for k in [*[(f, g) for g in GRAMS], (f, "digit")]]
    order += ["missing", *[(k, g) for k in ("intersect", "places") for g in GRAMS], *[(m, g, a, b) for m in SET_METRICS for g in GRAMS for a, b in combinations(fields, 2)]]
    for k in order:
        out |= held[k]
    return out


def counting_features(df: DataFrame, fields: tuple[str, ...] = FIELDS, *, sets: bool = False) -> DataFrame:
    """`df` with all 262 counting features, and if asked the set similarities, for word arrays <field>_tokens.

    They equal those of the expressions above, in time that grows with the words
    instead of the product of two fields' words.  A null list counts as empty;
    words aren't null.
    """
    empty = [pa.array([], pa.list_(pa.string()))] * len(fields)
    kinds = {n: x.dtype.kind + str(x.dtype.itemsize) for n, x in _measured(fields, empty).items() if sets or not n.startswith(tuple(SET_METRICS))}
    spark_kind, arrow_kind = {"i8": "bigint", "f8": "double", "i4": "int"}, {"i8": pa.int64(), "f8": pa.float64(), "i4": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(batch.schema.get_field_index(f"{f}_tokens")) for f in fields]
            upto = np.cumsum(sum(pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists) + 1)
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + SLICE, "right")))
                got = _measured(fields, [x.slice(lo, hi - lo) for x in lists])
                columns = [pa.array(got[n], arrow_kind[k]) for n, k in kinds.items()]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *kinds])
                lo = hi

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{own}, " + ", ".join(f"`{n}` {spark_kind[k]}" for n, k in kinds.items()))


def find_columns(df: DataFrame, part: str) -> list[str]:
    """Names of the columns that contain `part`."""
    return [c for c in df.columns if part in c]


def transform_of(name: str) -> str:
    """sqrt for counts and positions, else none."""
    return "sqrt" if name.startswith(("count", "pos_of")) else "identity"


def transformed(df: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` with their transform applied."""
    return df.withColumns({c: F.sqrt(c) if transform_of(c) == "sqrt" else F.col(c) for c in columns})
