"""Feature sets: columns against plain computations, and their places in the matrix."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemill.operators import lsa
from sievemill.operators.feature_table import Table
from sievemill.plans.feature_sets import counting_names, feature_set

TEXTS = ["red shoes for men", "blue shoes", "men red hat and red shoes", "hat", "", "shoes shoes men hat blue", "for men and men", "red and blue hat for shoes"]
ROWS = [(i, f"q{i % 2}", 1 + i % 3, TEXTS[i].split(), TEXTS[(i * 3 + 1) % 8].split(), (TEXTS[(i + 2) % 8] + " " + TEXTS[(i * 5) % 8]).split()) for i in range(8)]


@pytest.fixture(scope="module")
def table(spark):
    kinds = "id long, qid string, relevance int, query_tokens array<string>, title_tokens array<string>, description_tokens array<string>"
    return Table(spark.createDataFrame(ROWS, kinds), longest=2, min_df=2, max_df=0.9)


def grams(words, longest=2):
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain_weights(place, own=False):
    """tf-idf of one field, by id."""
    n = len(ROWS)
    fitted = Counter(t for r in ROWS for t in set(grams(r[place] if own else r[3] + r[4] + r[5])))
    vocabulary = {t for t, c in fitted.items() if 2 <= c <= 0.9 * n}
    tf = {r[0]: Counter(t for t in grams(r[place]) if t in vocabulary) for r in ROWS}
    df = Counter(t for c in tf.values() for t in c)
    raw = {i: {t: (1 + math.log(k)) * (math.log((1 + n) / (1 + df[t])) + 1) for t, k in c.items()} for i, c in tf.items()}
    return {i: {t: x / math.sqrt(sum(y * y for y in v.values())) for t, x in v.items()} for i, v in raw.items()}


def held(df):
    return {r.id: r.value for r in df.collect()}


def test_weights_cosines_and_statistics(table):
    title, description = plain_weights(4), plain_weights(5)
    cosine = lambda a, b: sum(x * b.get(t, 0.0) for t, x in a.items())
    got = held(table.feature("title_description_tfidf_cosine_sim"))
    assert all(math.isclose(got[i], cosine(title[i], description[i]), abs_tol=1e-9) for i in title) and len(got) == 8
    for by in ("relevance", "query_relevance"):
        got = held(table.feature(f"title_tfidf_cosine_sim_stats_by_{by}"))
        for r in ROWS:
            for c in (1, 2, 3, 4):
                x = [cosine(title[r[0]], title[o[0]]) for o in ROWS if o[0] != r[0] and o[2] == c and (by == "relevance" or o[1] == r[1])]
                want = [np.mean(x), np.std(x), min(x), np.median(x), max(x)] if x else [0.0] * 5
                assert np.allclose(got[r[0]][5 * c - 5 : 5 * c], want, atol=1e-9)
    raw = held(table.feature("title_tfidf"))
    assert {i: sorted(round(x, 9) for x in v.values()) for i, v in raw.items()} == {i: sorted(round(x, 9) for x in v.values()) for i, v in title.items()}


def test_latent_vectors_keep_lengths_under_a_full_decomposition(table):
    own = plain_weights(4, True)
    got = held(table.latent("title", 100))
    for a in own:
        for b in own:
            want = sum(x * own[b].get(t, 0.0) for t, x in own[a].items())
            assert len(got[a]) == 100 and math.isclose(float(np.dot(got[a], got[b])), want, abs_tol=1e-6)


def test_matrix_puts_columns_side_by_side(table):
    names = ["count_of_title_unigram", "title_tfidf", "title_tfidf_cosine_sim_stats_by_relevance", "title_tfidf_individual_svd100", "query_id_title_unigram_cooccurrence_tfidf", "qid"]
    columns = {r.id: r for r in table.columns(names).collect()}
    rows, width = table.matrix(names)
    widths = [1, table.widths["title_tfidf"], 20, 100, table.widths[names[4]], 2]
    assert width == sum(widths)
    for r in rows.collect():
        c = columns[r.id]
        dense = np.zeros(width)
        for i, v in r.features.items():
            dense[i] = v
        assert r.label == c.relevance - 1 and all(v for v in r.features.values())
        at = np.append(0, np.cumsum(widths))
        assert math.isclose(dense[0], math.sqrt(len(ROWS[r.id][4])))
        assert {i: v for i, v in enumerate(dense[at[1] : at[2]]) if v} == c.title_tfidf
        assert np.allclose(dense[at[2] : at[3]], c[names[2]]) and np.allclose(dense[at[3] : at[4]], c[names[3]])
        assert dense[at[5] :].tolist() == [1.0 * (ROWS[r.id][1] == "q0"), 1.0 * (ROWS[r.id][1] == "q1")]


def test_sets_have_their_sizes():
    assert [len(feature_set(n)) for n in ("low_1", "low_2", "low_3", "high")] == [170, 177, 177, 184] and len(counting_names()) == 142


def test_projection_adds_up_over_batches(spark):
    rows = [(i, t, float(i + 1)) for i in range(50) for t in "abc"]
    v = np.arange(6.0).reshape(3, 2)
    terms = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "term string, index int")
    got = {r.id: r.vector for r in lsa.project(spark.createDataFrame(rows, "id long, term string, weight double").repartition(5), terms, v).collect()}
    assert got == {i: ((i + 1) * v.sum(axis=0)).tolist() for i in range(50)}
    assert lsa.project(spark.createDataFrame(rows, "id long, term string, weight double").where(F.lit(False)), terms, v).collect() == []


@pytest.mark.parametrize("rows, width, k, basis", [(60, 40, 6, 2), (50, 90, 60, 16), (3, 5, 5, 16)])
def test_left_vectors_equal_a_dense_decomposition(spark, monkeypatch, rows, width, k, basis):
    monkeypatch.setattr(lsa, "CELLS", 200)
    monkeypatch.setattr(lsa, "BASIS", basis)
    made = np.random.default_rng(rows)
    m = (made.random((rows, width)) < 0.15) * made.random((rows, width))
    m[rows // 2 :] = m[: rows - rows // 2]  # copies: fewer vectors than rows
    cells = [(int(i) * 7, f"t{j:03d}", float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)]
    weights = spark.createDataFrame(cells, "id long, term string, weight double")
    found = lsa.left_vectors(weights, lsa.indexed_terms(weights.select("term").distinct()), k).collect()
    u, s, _ = np.linalg.svd(m)
    want = (u[:, : min(k, width)] * s[:k] if rows > width else u[:, :k] * s[:k])[:, : int((s[:k] > 1e-9).sum())]
    got = np.zeros_like(want)
    for r in found:
        got[r.id // 7] = r.vector
    assert {r.id for r in found} == {c[0] for c in cells}
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-9) and np.allclose((got * got).sum(axis=0), s[: want.shape[1]] ** 2)
    assert lsa.left_vectors(weights.limit(0), lsa.indexed_terms(weights.select("term").distinct()), k).collect() == []
