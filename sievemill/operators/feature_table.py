"""Feature sets end to end: every column of a set, computed and put side by side by id.

A feature is a number, an array of a fixed length (statistics by class, latent
vectors) or a map from place to value (weights of terms, places of ids).  What
several features need, term weights of a field, is written once in the shared
folder.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.ngrams import GRAMS
from ..sources.scratch import scratch
from . import counting, lsa, pooling, vectorize
from .counting import FIELDS
from .ranking import ranked

PAIRS = [(a, b) for i, a in enumerate(FIELDS) for b in FIELDS[i + 1 :]]


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Table:
    """Features of rows (id, qid, relevance, <field>_tokens), made as they are asked for by name.

    Ids are unique and not null.  Term weights are of runs of one to `longest`
    words; terms are those in at least `min_df` and at most `max_df` of the
    texts.
    """

    rows: DataFrame
    longest: int = 3
    min_df: int = 3
    max_df: float = 0.75
    widths: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.rows = _written(self.rows.select("id", "qid", "relevance", *[f"{f}_tokens" for f in FIELDS]), "rows")
        self.n = self.rows.count()
        self.ids = self.rows.select("id")
        self._held: dict = {}

    def _once(self, key: tuple, make):
        if key not in self._held:
            self._held[key] = make()
        return self._held[key]

    # weights of terms

    def _tf(self, name: str) -> DataFrame:
        words = F.concat(*[f"{f}_tokens" for f in FIELDS]) if name == "all" else F.col(f"{name}_tokens")
        rows = self.rows.select("id", words.alias("w")).where("w is not null")
        return self._once(("tf", name), lambda: _written(vectorize.run_counts(rows, "w", self.longest), f"tf-{name}"))

    def _vocabulary(self, name: str) -> DataFrame:
        return self._once(("vocabulary", name), lambda: _written(vectorize.vocabulary(self._tf(name), self.n, self.min_df, self.max_df), f"vocabulary-{name}"))

    def weights(self, kind: str, name: str, own: bool = False) -> DataFrame:
        """id, term, weight of a field: tfidf or bow, under the vocabulary of all fields together or the field's own."""

        def make() -> DataFrame:
            if kind == "bow":
                return _written(vectorize.bag_of_words(self._tf(name), self._vocabulary("all")), f"bow-{name}")
            vocabulary = self._vocabulary(name if own else "all")
            return _written(vectorize.tfidf(self._tf(name), vocabulary, self.n, refit=not own), f"tfidf-{name}")

        return self._once(("weights", kind, name, own), make)

    def _cells(self, weights: DataFrame) -> DataFrame:
        """id, value: each row's terms and weights; a text without terms is empty."""
        cells = weights.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("value"))  # bounded by the text
        empty = F.array().cast(cells.schema["value"].dataType)
        return self.ids.join(cells, "id", "left").withColumn("value", F.coalesce("value", empty))

    def latent(self, name: str, k: int, common: bool = False) -> DataFrame:
        """id, value: latent vectors of a field, decomposed by itself or with all fields below each other."""

        def fit() -> DataFrame:
            """id, vector; of all fields: row, vector."""
            if common:
                parts = [self.weights("tfidf", f).select((F.col("id") * len(FIELDS) + i).alias("id"), "term", "weight") for i, f in enumerate(FIELDS)]
                weights = parts[0].unionByName(parts[1]).unionByName(parts[2])
            else:
                weights = self.weights("tfidf", name, True)
            own = "all" if common else name
            terms = self._once(("terms", own), lambda: _written(lsa.indexed_terms(self._vocabulary(own)), "terms"))
            return _written(lsa.left_vectors(weights, terms, k), "svd")

        def make() -> DataFrame:
            found = self._once(("svd", None if common else name, k), fit)
            if common:
                place = FIELDS.index(name)
                found = found.where(F.pmod("id", F.lit(len(FIELDS))) == place).select(((F.col("id") - place) / len(FIELDS)).cast("bigint").alias("id"), "vector")
            zeros = F.array_repeat(F.lit(0.0), k)
            padded = F.slice(F.concat("vector", zeros), 1, k)
            return _written(self.ids.join(found, "id", "left").select("id", F.coalesce(padded, zeros).alias("value")), "latent")

        return self._once(("latent", name, k, common), make)

    # blocks of features by name

    def counts(self) -> DataFrame:
        """All counting features and set similarities, counts and positions as square roots."""

        def make() -> DataFrame:
            out = counting.counting_features(self.rows, sets=True)
            names = [c for c in out.columns if c not in self.rows.columns and out.schema[c].dataType.typeName() != "array"]
            return _written(counting.transformed(out, names).select("id", *[F.col(c).cast("double").alias(c) for c in names]), "counts")

        return self._once(("counts",), make)

    def _statistics(self, cells: DataFrame, metric: str, by: str) -> DataFrame:
        rows = self.rows.select("id", "qid", F.col("relevance").alias("r")).join(cells, "id")
        out = pooling.pooled_stats(rows, rows, metric, key="qid" if by == "query_relevance" else None)
        return out.select("id", F.array(*[c for c in out.columns if c != "id"]).alias("value"))

    def _placed(self, weights: DataFrame, vocabulary: DataFrame, name: str) -> DataFrame:
        terms = _written(lsa.indexed_terms(vocabulary), "terms")
        self.widths[name] = terms.count()
        cells = weights.join(terms, "term").groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("index", "weight")))).alias("value"))
        return self.ids.join(cells, "id", "left").withColumn("value", F.coalesce("value", F.create_map().cast("map<int,double>")))

    def feature(self, name: str) -> DataFrame:
        """id, value of one feature."""
        parts = name.split("_")
        if name == "qid":
            seen = ranked(self.rows.select("qid").where("qid is not null").distinct(), ["qid"], "at")
            seen = _written(seen, "qids")
            self.widths[name] = seen.count()
            return self.rows.select("id", "qid").join(seen, "qid", "left").select("id", F.when(F.col("at").isNotNull(), F.map_from_arrays(F.array(F.col("at").cast("int")), F.array(F.lit(1.0)))).otherwise(F.create_map().cast("map<int,double>")).alias("value"))
        if name.endswith("cooccurrence_tfidf"):
            left = F.array(F.concat(F.lit("qid"), F.coalesce(F.col("qid").cast("string"), F.lit("")))) if parts[1] == "id" else GRAMS[parts[1]](F.col("query_tokens"))
            pairs = self.rows.select("id", left.alias("a"), GRAMS[parts[3]](F.col(f"{parts[2]}_tokens")).alias("b"))
            weights = _written(vectorize.pair_terms(vectorize.pair_tfidf(pairs, self.n, self.min_df, self.max_df)), "tfidf-pairs")
            return self._placed(weights, weights.select("term").distinct(), name)  # each of the vocabulary is in some row
        if "individual" in parts or "common" in parts:
            common, k = "common" in parts, int(next(p for p in parts if p.startswith("svd"))[3:])
            if "stats" in parts:
                return self._statistics(self.latent(parts[0], k, common), "cosine", name.partition("_by_")[2])
            if "cosine" in parts:
                a, b = (self.latent(f, k, common).withColumnRenamed("value", f) for f in parts[:2])
                return a.join(b, "id").select("id", arrays.cosine(F.col(parts[0]), F.col(parts[1])).alias("value"))
            self.widths[name] = k
            return self.latent(parts[0], k, common)
        kind = next((p for p in parts if p in ("tfidf", "bow")), None)
        if kind and "stats" in parts:
            return self._statistics(self._cells(self.weights(kind, parts[0])), "terms", name.partition("_by_")[2])
        if kind and "cosine" in parts:
            a, b = (self.weights(kind, f) for f in parts[:2])
            return vectorize.row_cosine(a, b, self.ids).withColumnRenamed("similarity", "value")
        if kind:
            return self._placed(self.weights(kind, parts[0]), self._vocabulary("all"), name)
        return self.counts().select("id", F.col(name).alias("value"))

    def columns(self, names: list[str]) -> DataFrame:
        """id, relevance and a column for each feature."""
        known = set(self.counts().columns)
        out = self.rows.select("id", "relevance").join(self.counts().select("id", *[n for n in names if n in known]), "id")
        for n in names:
            if n not in known:
                made = self.feature(n).withColumnRenamed("value", n)
                kind = made.schema[n].dataType.typeName()
                self.widths.setdefault(n, 1 if kind == "double" else len(pooling.CLASSES) * len(pooling.STATS))
                out = out.join(made, "id")
        return out.select("id", "relevance", *names)

    def matrix(self, names: list[str]) -> tuple[DataFrame, int]:
        """(id, label from 0, features: a map from place to value, without zeros; the number of places)."""
        out, offset, cells = self.columns(names), 0, []
        for n in names:
            cells.append(_entries(F.col(f"`{n}`"), out.schema[n].dataType.typeName(), offset))
            offset += self.widths.get(n, 1)
        some = F.filter(F.concat(*cells), lambda c: c["v"] != 0)
        return out.select("id", (F.col("relevance") - 1).alias("label"), F.map_from_entries(some).alias("features")), offset


def _entries(value: Column, kind: str, offset: int) -> Column:
    """A feature's numbers as an array of (place, value)."""
    pair = lambda i, v: F.struct(i.cast("int").alias("i"), v.cast("double").alias("v"))
    if kind == "map":
        return F.transform(F.map_entries(value), lambda e: pair(e["key"] + offset, e["value"]))
    if kind == "array":
        return F.transform(value, lambda x, i: pair(i + offset, x))
    return F.array(pair(F.lit(offset), value))
