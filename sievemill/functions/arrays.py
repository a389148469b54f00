"""Counts, positions and similarities of arrays, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_divide(x: Column, y: Column, default: float = 0.0) -> Column:
    """x / y, or `default` where y is 0."""
    return F.when(y != 0, x.cast("double") / y.cast("double")).otherwise(F.lit(default))


def intersect_count(a: Column, b: Column) -> Column:
    """Items of a, repeated ones each, that b has."""
    return F.size(F.filter(a, lambda w: F.array_contains(b, w))).cast("long")


def positions(target: Column, obs: Column) -> Column:
    """1-based places in obs of the items that target has; [0] if there are none."""
    found = F.filter(F.transform(obs, lambda w, i: F.when(F.array_contains(target, w), i + 1)), lambda i: i.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(0)))


def mean(xs: Column) -> Column:
    """Mean of a numeric array that isn't empty."""
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs)


def median(xs: Column) -> Column:
    """Median: the middle item, or the mean of the two in the middle."""
    s, n = F.array_sort(xs), F.size(xs)
    low, high = F.element_at(s, F.floor((n + 1) / 2).cast("int")), F.element_at(s, F.floor((n + 2) / 2).cast("int"))
    return (low + high) / F.lit(2.0)


def std(xs: Column) -> Column:
    """Population standard deviation."""
    m = mean(xs)
    return F.sqrt(F.aggregate(xs, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(xs))


STATS = {"min": lambda x: F.array_min(x).cast("double"), "mean": mean, "median": median, "max": lambda x: F.array_max(x).cast("double"), "std": std}


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct items; 0 if there are none."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return safe_divide(both, either)


def dice(a: Column, b: Column) -> Column:
    """Twice the shared over the sum of distinct items; 0 if there are none."""
    both = F.size(F.array_intersect(a, b))
    return safe_divide(2 * both, F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)))


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two arrays of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is 0."""
    return safe_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


SET_METRICS = {"jaccard_coef": jaccard, "dice_dist": dice}
VECTOR_METRICS = {"cosine": cosine, "euclidean": euclidean}


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x))."""
    return 1.0 / (1.0 + F.exp(-x))


def softmax(xs: Column, shift: Column | None = None) -> Column:
    """Exponentials over their sum; `shift` (default: the row's maximum) keeps them small and changes nothing else."""
    top = F.array_max(xs) if shift is None else shift
    es = F.transform(xs, lambda x: F.exp(x - top))
    total = F.aggregate(es, F.lit(0.0), lambda s, x: s + x)
    return F.transform(es, lambda x: x / total)
