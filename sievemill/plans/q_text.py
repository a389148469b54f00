"""Queries on texts, arrays and term weights."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, ngrams, text
from ..functions.stem import stem_column
from ..operators import counting, lsa, pooling, vectorize
from ..operators.markup import drop_markup
from ..operators.preprocess import preprocess
from ..sources.scratch import scratch
from .fixtures import PAIRS_SQL, SAMPLES_SQL, read, samples, tokenized, turn_pairs

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function by its name, with its SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def tok(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def bi(w: str) -> str:
    return f"(CASE WHEN len({w}) > 1 THEN list_transform(range(1, len({w})), lambda i: {w}[i] || '_' || {w}[i + 1]) ELSE {w} END)"


def tri(w: str) -> str:
    return f"(CASE WHEN len({w}) > 2 THEN list_transform(range(1, len({w}) - 1), lambda i: {w}[i] || '_' || {w}[i + 1] || '_' || {w}[i + 2]) ELSE {bi(w)} END)"


def div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) <> 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0.0 END)"


def held(a: str, b: str) -> str:
    return f"len(list_filter({a}, lambda w: list_contains({b}, w)))"


def pos(target: str, obs: str) -> str:
    found = f"list_filter(list_transform({obs}, lambda w, i: CASE WHEN list_contains({target}, w) THEN i END), lambda z: z IS NOT NULL)"
    return f"(CASE WHEN len({found}) > 0 THEN {found} ELSE [0] END)"


def jac(a: str, b: str) -> str:
    return div(f"len(list_intersect(list_distinct({a}), list_distinct({b})))", f"len(list_distinct(list_concat({a}, {b})))")


def dic(a: str, b: str) -> str:
    return div(f"2 * len(list_intersect(list_distinct({a}), list_distinct({b})))", f"len(list_distinct({a})) + len(list_distinct({b}))")


T_SQL = f"{PAIRS_SQL}, t AS (SELECT conv_id, turn, {tok('query')} AS q, {tok('title')} AS p FROM turn_pairs)"


@query(f"WITH {T_SQL} SELECT conv_id, turn, CAST(len(q) AS BIGINT) AS n_query, CAST(len(p) AS BIGINT) AS n_title, CAST({held('q', 'p')} AS BIGINT) AS n_shared, round({jac('q', 'p')}, 6) AS jaccard FROM t")
def turn_pair_overlap(spark, sf):
    """Words, shared words and Jaccard similarity of each user turn and its reply."""
    q, p = text.tokens(F.col("query")), text.tokens(F.col("title"))
    rows = turn_pairs(spark, sf).select("conv_id", "turn", q.alias("q"), p.alias("p"))
    return rows.select("conv_id", "turn", F.size("q").cast("long").alias("n_query"), F.size("p").cast("long").alias("n_title"), arrays.intersect_count(F.col("q"), F.col("p")).alias("n_shared"), F.round(arrays.jaccard(F.col("q"), F.col("p")), 6).alias("jaccard"))


@query("SELECT page_id, regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g') AS plain FROM pages")
def drop_html(spark, sf):
    """Pages without markup."""
    return read(spark, sf, "pages").select("page_id", text.drop_html(F.coalesce("html", F.lit(""))).alias("plain"))


@query()
def page_text(spark, sf):
    """Texts of all pages: entities read, comments, scripts and styles left out."""
    return drop_markup(read(spark, sf, "pages").select("page_id", "html"), "html").withColumnRenamed("html", "plain")


def _sql_rules(expr: str, rules) -> str:
    for a, b in rules:
        expr = f"regexp_replace({expr}, '{a.replace(chr(39), chr(39) * 2)}', '{b}', 'g')"
    return expr


UNITS = "SELECT doc_id, CAST(doc_id % 97 AS VARCHAR) || ' 16 gb, 64 g card 128g and 500 gb or 2 tb; 32 games ' || text AS s FROM documents"


def _units(spark, sf):
    head = F.concat((F.col("doc_id") % 97).cast("string"), F.lit(" 16 gb, 64 g card 128g and 500 gb or 2 tb; 32 games "), F.col("text"))
    return read(spark, sf, "documents").select("doc_id", head.alias("s"))


@query(f"SELECT doc_id, {_sql_rules('lower(s)', text.unit_rules())} AS cleaned FROM ({UNITS})")
def unit_normalisation(spark, sf):
    """Sizes and units joined."""
    return _units(spark, sf).select("doc_id", text.rewrite(F.lower("s"), text.unit_rules()).alias("cleaned"))


PHRASES = "SELECT item_id, text || ' playstation 3 (ps 4) hard disk 12-ounce k-cups video games eau de toilette e-reader levis' AS s FROM benchmark"


@query(f"SELECT item_id, {_sql_rules('lower(s)', text.REPLACEMENTS)} AS cleaned FROM ({PHRASES})")
def phrase_replacement(spark, sf):
    """The rewrite rules, in order."""
    s = F.concat("text", F.lit(" playstation 3 (ps 4) hard disk 12-ounce k-cups video games eau de toilette e-reader levis"))
    return read(spark, sf, "benchmark").select("item_id", text.rewrite(F.lower(s), text.REPLACEMENTS).alias("cleaned"))


SYNONYMS = {"the": "das", "of": "von", "and": "und", "thin": "slim", "das": "once"}


@query(f"SELECT doc_id, array_to_string(list_transform(string_split(lower(text), ' '), lambda w: CASE {' '.join(f'WHEN w = {chr(39)}{a}{chr(39)} THEN {chr(39)}{b}{chr(39)}' for a, b in SYNONYMS.items())} ELSE w END), ' ') AS cleaned FROM documents")
def synonym_words(spark, sf):
    """Exact words replaced in one pass."""
    return read(spark, sf, "documents").select("doc_id", text.replace_words(F.lower("text"), SYNONYMS).alias("cleaned"))


@query(f"SELECT doc_id, array_to_string(list_transform(string_split({_sql_rules('lower(regexp_replace(s, ' + chr(39) + '<[^>]*>' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + '))', text.unit_rules() + text.REPLACEMENTS)}, ' '), lambda w: CASE WHEN w = 'the' THEN 'das' ELSE w END), ' ') AS cleaned FROM (SELECT doc_id, '<b>16 gb</b> playstation ' || s AS s FROM ({UNITS}))")
def clean_text(spark, sf):
    """Markup, case, units, rules and synonyms in one expression."""
    s = F.concat(F.lit("<b>16 gb</b> playstation "), "s")
    return _units(spark, sf).select("doc_id", text.clean_text(s, html=True, synonyms={"the": "das"}).alias("cleaned"))


@query("SELECT doc_id, CAST(len(w) AS BIGINT) AS n, array_to_string(w, ' ') AS words FROM (SELECT doc_id, " + tok("text") + " AS w FROM documents)")
def tokens(spark, sf):
    """Words of all documents."""
    w = text.tokens(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.array_join(w, " ").alias("words"))


STOP = ["the", "of", "and", "to", "is", "de", "la", "der", "die"]


@query(f"SELECT doc_id, array_to_string(list_filter({tok('text')}, lambda w: w NOT IN ({', '.join(repr(s) for s in STOP)})), ' ') AS words FROM documents")
def stop_words(spark, sf):
    """Words that aren't in a stop list."""
    return read(spark, sf, "documents").select("doc_id", F.array_join(text.without(text.tokens(F.col("text")), STOP), " ").alias("words"))


WITHOUT = lambda c: f"list_filter({tok(c)}, lambda w: w NOT IN ({', '.join(repr(s) for s in STOP)}))"


@query(f"WITH {PAIRS_SQL}, t AS (SELECT conv_id, turn, {WITHOUT('query')} AS q, {WITHOUT('title')} AS p FROM turn_pairs) SELECT conv_id, turn, array_to_string(q, ' ') AS query, array_to_string(p, ' ') AS title, CAST({held('q', 'p')} AS BIGINT) AS n_shared, round({jac('q', 'p')}, 6) AS jaccard FROM t")
def preprocessed_words(spark, sf):
    """Words without stop words of each user turn and its reply, and what they share."""
    rows = preprocess(turn_pairs(spark, sf), ["query", "title"], stop=STOP, stem=False)
    q, p = F.col("query_tokens"), F.col("title_tokens")
    return rows.select("conv_id", "turn", F.array_join(q, " ").alias("query"), F.array_join(p, " ").alias("title"), arrays.intersect_count(q, p).alias("n_shared"), F.round(arrays.jaccard(q, p), 6).alias("jaccard"))


@query()
def preprocessed_features(spark, sf):
    """All counting features of the samples' words without stop words, stemmed."""
    rows = preprocess(samples(spark, sf).select("id", "query", "title", "description"), ["query", "title", "description"], stop=STOP)
    out = counting.counting_features(rows.drop("query", "title", "description"))
    return out.select(*[f.name for f in out.schema if f.dataType.typeName() not in ("array", "string")])


@query(f"SELECT doc_id, CAST(len(list_filter({tok('text')}, lambda w: regexp_full_match(w, '[0-9]+'))) AS BIGINT) AS digits FROM documents")
def digit_counts(spark, sf):
    """Words of digits in all documents."""
    return read(spark, sf, "documents").select("doc_id", text.count_digits(text.tokens(F.col("text"))).alias("digits"))


@query("SELECT doc_id, strip_accents(text) AS plain FROM documents")
def accents(spark, sf):
    """Letters without marks."""
    return read(spark, sf, "documents").select("doc_id", text.strip_accents(F.col("text")).alias("plain"))


@query("SELECT conv_id, turn, query || ' ' || title AS all_text FROM (WITH " + PAIRS_SQL + " SELECT * FROM turn_pairs)")
def all_text(spark, sf):
    """Fields joined."""
    return turn_pairs(spark, sf).select("conv_id", "turn", text.all_text(F.col("query"), F.col("title")).alias("all_text"))


@query()
def stemmed_words(spark, sf):
    """Stems of the documents' distinct words, with how often they occur."""
    words = read(spark, sf, "documents").select(F.explode(text.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return stem_column(words, "word").groupBy("word").agg(F.sum("n").alias("n"))


ANTONYMS = {"good": "bad", "of": "off", "the": "no"}
NOT = "(CASE w[i] " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ANTONYMS.items()) + " END)"


@query(f"""WITH t AS (SELECT doc_id, list_concat(['not', 'good', 'not', 'not', 'of'], flatten(list_transform({tok('text')}, lambda x: CASE WHEN x = 'the' OR x = 'is' THEN ['not', x] ELSE [x] END))) AS w FROM documents)
SELECT doc_id, array_to_string(list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN w[i] = 'not' AND {NOT.replace('w[i]', 'w[i + 1]')} IS NOT NULL THEN NULL WHEN i > 1 AND w[i - 1] = 'not' THEN coalesce({NOT}, w[i]) ELSE w[i] END), lambda x: x IS NOT NULL), ' ') AS words FROM t""")
def negation_replacement(spark, sf):
    """not x as x's antonym, in documents with some words denied."""
    denied = F.flatten(F.transform(text.tokens(F.col("text")), lambda x: F.when(x.isin("the", "is"), F.array(F.lit("not"), x)).otherwise(F.array(x))))
    w = F.concat(F.array(*[F.lit(x) for x in ("not", "good", "not", "not", "of")]), denied)
    return read(spark, sf, "documents").select("doc_id", F.array_join(text.replace_negations(w, ANTONYMS), " ").alias("words"))


FOUR = "(CASE WHEN len(w) > 3 THEN list_transform(range(1, len(w) - 2), lambda i: w[i] || '_' || w[i + 1] || '_' || w[i + 2] || '_' || w[i + 3]) ELSE " + tri("w") + " END)"
ITEMS = "(SELECT item_id, " + tok("text") + " AS w FROM benchmark)"
PARTS = "(SELECT p_partkey, " + tok("p_name || ' ' || p_type") + " AS w FROM part)"


def _items(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", text.tokens(F.col("text")).alias("w"))


def _parts(spark, sf):
    return read(spark, sf, "part").select("p_partkey", text.tokens(F.concat_ws(" ", "p_name", "p_type")).alias("w"))


@query(f"SELECT item_id, array_to_string(w, ' ') AS unigrams, array_to_string({bi('w')}, ' ') AS bigrams, array_to_string({tri('w')}, ' ') AS trigrams, array_to_string({FOUR}, ' ') AS fourgrams FROM {ITEMS}")
def ngram_lists(spark, sf):
    """Unigrams to fourgrams of all benchmark items."""
    w = F.col("w")
    joined = lambda x: F.array_join(x, " ")
    return _items(spark, sf).select("item_id", joined(ngrams.unigrams(w)).alias("unigrams"), joined(ngrams.bigrams(w)).alias("bigrams"), joined(ngrams.trigrams(w)).alias("trigrams"), joined(ngrams.fourgrams(w)).alias("fourgrams"))


BT = "(CASE WHEN len(w) > 1 THEN flatten(list_transform(range(1, len(w)), lambda i: list_transform(range(i + 1, len(w) + 1), lambda j: w[i] || '_' || w[j]))) ELSE w END)"
TT = "(CASE WHEN len(w) > 2 THEN flatten(list_transform(range(1, len(w) - 1), lambda i: flatten(list_transform(range(i + 1, len(w)), lambda j: list_transform(range(j + 1, len(w) + 1), lambda k: w[i] || '_' || w[j] || '_' || w[k]))))) ELSE " + BT + " END)"


@query(f"SELECT p_partkey, array_to_string({BT}, ' ') AS biterms, array_to_string({TT}, ' ') AS triterms FROM {PARTS}")
def term_combinations(spark, sf):
    """All pairs and triples of the words of each part's name and type."""
    return _parts(spark, sf).select("p_partkey", F.array_join(ngrams.biterms(F.col("w")), " ").alias("biterms"), F.array_join(ngrams.triterms(F.col("w")), " ").alias("triterms"))


SKIP_BI = "(CASE WHEN len(w) > 1 THEN flatten(list_transform(range(1, len(w)), lambda i: list_transform(list_filter([1, 2], lambda k: i + k <= len(w)), lambda k: w[i] || '_' || w[i + k]))) ELSE w END)"
SKIP_TRI = "(CASE WHEN len(w) > 2 THEN flatten(list_transform(range(1, len(w) - 1), lambda i: list_transform(list_filter([[1, 1], [1, 2], [2, 1], [2, 2]], lambda k: i + k[1] + k[2] <= len(w)), lambda k: w[i] || '_' || w[i + k[1]] || '_' || w[i + k[1] + k[2]]))) ELSE " + SKIP_BI + " END)"


@query(f"SELECT item_id, array_to_string({SKIP_BI}, ' ') AS bigrams, array_to_string({SKIP_TRI}, ' ') AS trigrams FROM {ITEMS}")
def skip_grams(spark, sf):
    """Pairs and triples with up to one word left out between neighbours."""
    return _items(spark, sf).select("item_id", F.array_join(ngrams.bigrams(F.col("w"), skip=1), " ").alias("bigrams"), F.array_join(ngrams.trigrams(F.col("w"), skip=1), " ").alias("trigrams"))


CO = lambda a, b: f"array_to_string(flatten(list_transform({a}, lambda x: list_transform({b}, lambda y: x || 'X' || y))), ' ')"


@query(f"WITH {PAIRS_SQL}, t AS (SELECT conv_id, turn, {tok('query')} AS q, {tok('title')} AS p FROM turn_pairs) SELECT conv_id, turn, {CO('q', 'p')} AS uni_uni, {CO('q', bi('p'))} AS uni_bi, {CO(bi('q'), 'p')} AS bi_uni, {CO(bi('q'), bi('p'))} AS bi_bi, {CO('[' + chr(39) + 'qid' + chr(39) + ' || conv_id]', 'p')} AS id_uni, {CO('[' + chr(39) + 'qid' + chr(39) + ' || conv_id]', bi('p'))} AS id_bi FROM t")
def cooccurrence(spark, sf):
    """Terms of the query, or its id, with terms of the reply."""
    rows = turn_pairs(spark, sf).select("conv_id", "turn", text.tokens(F.col("query")).alias("q"), text.tokens(F.col("title")).alias("p"))
    q, p, i = F.col("q"), F.col("p"), F.array(F.concat(F.lit("qid"), "conv_id"))
    pairs = {"uni_uni": (q, p), "uni_bi": (q, ngrams.bigrams(p)), "bi_uni": (ngrams.bigrams(q), p), "bi_bi": (ngrams.bigrams(q), ngrams.bigrams(p)), "id_uni": (i, p), "id_bi": (i, ngrams.bigrams(p))}
    return rows.select("conv_id", "turn", *[ngrams.cooccurrence_text(a, b).alias(n) for n, (a, b) in pairs.items()])


def _two(spark, sf) -> DataFrame:
    rows = tokenized(turn_pairs(spark, sf), "query", "title")
    return counting.with_grams(rows, ("query", "title"))


G_SQL = T_SQL + f", g AS (SELECT conv_id, turn, q AS query_unigram, p AS title_unigram, {bi('q')} AS query_bigram, {bi('p')} AS title_bigram, {tri('q')} AS query_trigram, {tri('p')} AS title_trigram FROM t)"


def _basic_sql(fields=("query", "title")) -> str:
    out = []
    for f in fields:
        for g in ("unigram", "bigram", "trigram"):
            a = f"{f}_{g}"
            out += [f"CAST(len({a}) AS BIGINT) AS count_of_{f}_{g}", f"CAST(len(list_distinct({a})) AS BIGINT) AS count_of_unique_{f}_{g}", f"round({div(f'len(list_distinct({a}))', f'len({a})')}, 6) AS ratio_of_unique_{f}_{g}"]
        d = f"len(list_filter({f}_unigram, lambda w: regexp_full_match(w, '[0-9]+')))"
        out += [f"CAST({d} AS BIGINT) AS count_of_digit_in_{f}", f"round({div(d, f'len({f}_unigram)')}, 6) AS ratio_of_digit_in_{f}"]
    return ", ".join([*out, f"CAST(len({fields[-1]}_unigram) = 0 AS INT) AS {fields[-1]}_missing"])


def _rounded(columns: dict) -> list:
    return [F.round(c, 6).alias(n) if n.startswith(("ratio", "title_", "normalized", "jaccard", "dice")) and not n.endswith("missing") else c.alias(n) for n, c in columns.items()]


@query(f"WITH {G_SQL} SELECT conv_id, turn, {_basic_sql()} FROM g")
def basic_counts(spark, sf):
    """Sizes, distinct sizes, digits and the missing mark."""
    return _two(spark, sf).select("conv_id", "turn", *_rounded(counting.basic_counts(("query", "title"))))


def _intersect_sql(fields=("query", "title")) -> str:
    out, q = [], fields[0]
    for g in ("unigram", "bigram", "trigram"):
        n = {(a, b): held(f"{a}_{g}", f"{b}_{g}") for a, b in permutations(fields, 2)}
        for (a, b), x in n.items():
            out += [f"CAST({x} AS BIGINT) AS count_of_{a}_{g}_in_{b}", f"round({div(x, f'len({a}_{g})')}, 6) AS ratio_of_{a}_{g}_in_{b}"]
        for f in fields[1:]:
            out += [f"round({div(n[f, q], f'len({q}_{g})')}, 6) AS {f}_{g}_in_{q}_div_{q}_{g}", f"round({div(n[f, q], n[q, f])}, 6) AS {f}_{g}_in_{q}_div_{q}_{g}_in_{f}"]
    return ", ".join(out)


@query(f"WITH {G_SQL} SELECT conv_id, turn, {_intersect_sql()} FROM g")
def intersect_counts(spark, sf):
    """Shared grams and cross ratios."""
    return _two(spark, sf).select("conv_id", "turn", *_rounded(counting.intersect_counts(("query", "title"))))


def _stats_sql(fields=("query", "title")) -> str:
    out = []
    for g in ("unigram", "bigram", "trigram"):
        for a, b in permutations(fields, 2):
            p = f"CAST({pos(f'{a}_{g}', f'{b}_{g}')} AS DOUBLE[])"
            for s, f in (("min", "list_min"), ("mean", "list_avg"), ("median", "list_median"), ("max", "list_max"), ("std", "list_stddev_pop")):
                x = f"{f}({p})"
                out += [f"round({x}, 6) AS pos_of_{b}_{g}_in_{a}_{s}", f"round({div(x, f'len({b}_{g})')}, 6) AS normalized_pos_of_{b}_{g}_in_{a}_{s}"]
    return ", ".join(out)


@query(f"WITH {G_SQL} SELECT conv_id, turn, {_stats_sql()} FROM g")
def position_stats(spark, sf):
    """Places of shared grams: five statistics, plain and normalized."""
    out = counting.position_stats(_two(spark, sf), ("query", "title"))
    return out.select("conv_id", "turn", *[F.round(c, 6).alias(c) for c in counting.find_columns(out, "pos_of_")])


@query(f"WITH {G_SQL} SELECT conv_id, turn, " + ", ".join(f"round({make(f'query_{g}', f'title_{g}')}, 6) AS {m}_of_{g}_between_query_title" for m, make in (("jaccard_coef", jac), ("dice_dist", dic)) for g in ("unigram", "bigram", "trigram")) + " FROM g")
def set_distances(spark, sf):
    """Jaccard and Dice similarities of all grams."""
    return _two(spark, sf).select("conv_id", "turn", *_rounded(counting.distances(("query", "title"))))


FIELDS = ("query", "title", "description")
ALL_GRAMS = ", ".join(f"{c} AS {f}_{g}" for f in FIELDS for g, c in (("unigram", f), ("bigram", bi(f)), ("trigram", tri(f))))


@query(f"WITH {SAMPLES_SQL}, t AS (SELECT id, relevance, variance, {', '.join(f'{tok(f)} AS {f}' for f in FIELDS)} FROM samples), g AS (SELECT id, relevance, variance, {ALL_GRAMS} FROM t) SELECT id, relevance, round(variance, 6) AS variance, {_basic_sql(FIELDS)}, {_intersect_sql(FIELDS)}, {_stats_sql(FIELDS)} FROM g")
def counting_features(spark, sf):
    """All 262 counting features of the samples."""
    rows = tokenized(samples(spark, sf), *FIELDS).drop(*FIELDS)
    out = counting.counting_features(rows, FIELDS)
    plain = [f for f in out.schema if f.dataType.typeName() != "array"]
    return out.select(*[F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in plain])


def _set_columns_sql() -> str:
    from .feature_sets import counting_names, distance_names

    gone = ", ".join(f"round({make(f'{a}_{g}', f'{b}_{g}')}, 6) AS {m}_of_{g}_between_{a}_{b}" for m, make in (("jaccard_coef", jac), ("dice_dist", dic)) for g in ("unigram", "bigram", "trigram") for a, b in (("query", "title"), ("query", "description"), ("title", "description")))
    names = [f"round({f'sqrt(CAST({c} AS DOUBLE))' if counting.transform_of(c) == 'sqrt' else f'CAST({c} AS DOUBLE)'}, 5) AS {c}" for c in counting_names() + distance_names()]
    return f"WITH {SAMPLES_SQL}, t AS (SELECT id, {', '.join(f'{tok(f)} AS {f}' for f in FIELDS)} FROM samples), g AS (SELECT id, {ALL_GRAMS} FROM t), f AS (SELECT id, {_basic_sql(FIELDS)}, {_intersect_sql(FIELDS)}, {_stats_sql(FIELDS)}, {gone} FROM g) SELECT id, {', '.join(names)} FROM f".replace(", 6) AS", ", 12) AS")


def feature_set_columns(spark, sf):
    """The 160 features that all sets share, as they go into them."""
    from ..operators.feature_table import Table
    from .feature_sets import counting_names, distance_names

    rows = tokenized(samples(spark, sf).select("id", F.col("query").alias("qid"), "relevance", *FIELDS), *FIELDS)
    out = Table(rows).columns(counting_names() + distance_names())
    return out.select("id", *[F.round(c, 5).alias(c) for c in out.columns if c not in ("id", "relevance")])


QUERIES["feature_set_columns"], ORACLES["feature_set_columns"] = feature_set_columns, _set_columns_sql()


@query(f"WITH {G_SQL} SELECT conv_id, turn, round(sqrt(CAST(len(query_unigram) AS DOUBLE)), 6) AS count_of_query_unigram, round({div('len(list_distinct(query_unigram))', 'len(query_unigram)')}, 6) AS ratio_of_unique_query_unigram FROM g")
def feature_transform(spark, sf):
    """Square roots of counts; ratios as they are."""
    rows = _two(spark, sf).withColumns(counting.basic_counts(("query", "title")))
    names = ["count_of_query_unigram", "ratio_of_unique_query_unigram"]
    return counting.transformed(rows, names).select("conv_id", "turn", *[F.round(n, 6).alias(n) for n in names])


VOCAB_SQL = f"""tf AS (SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tok('text')}) AS term FROM documents) GROUP BY 1, 2),
vocab AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 3 AND count(*) <= 0.75 * (SELECT count(*) FROM documents))"""


def _tf(spark, sf):
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), text.tokens(F.col("text")).alias("w"))
    return vectorize.document_counts(docs, "w"), read(spark, sf, "documents").count()


@query(f"WITH {VOCAB_SQL} SELECT term, CAST(df AS BIGINT) AS df FROM vocab")
def vocabulary(spark, sf):
    """Words in 3 to 75 % of the documents."""
    tf, n = _tf(spark, sf)
    return vectorize.vocabulary(tf, n)


@query(f"WITH {VOCAB_SQL} SELECT id, term, CAST(tf AS DOUBLE) AS weight FROM tf JOIN vocab USING (term)")
def bag_of_words(spark, sf):
    """Counts of the vocabulary's words."""
    tf, n = _tf(spark, sf)
    return vectorize.bag_of_words(tf, vectorize.vocabulary(tf, n)).select("id", "term", "weight")


TFIDF = f"""{VOCAB_SQL}, raw AS (SELECT id, term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS raw FROM tf JOIN vocab USING (term)),
weights AS (SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight FROM raw)"""


@query(f"WITH {TFIDF} SELECT id, term, round(weight, 6) AS weight FROM weights")
def tfidf(spark, sf):
    """Sublinear, smooth weights of length 1."""
    tf, n = _tf(spark, sf)
    return vectorize.tfidf(tf, vectorize.vocabulary(tf, n), n).select("id", "term", F.round("weight", 6).alias("weight"))


RUNS = f"""w AS (SELECT doc_id AS id, {tok('text')} AS w FROM documents), terms AS (SELECT id, unnest(w) AS term FROM w
UNION ALL SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
UNION ALL SELECT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
tf AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY 1, 2)"""
VOCAB = "vocab AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 3 AND count(*) <= 0.75 * (SELECT n FROM n))"
WEIGHTS = """raw AS (SELECT id, term, (1 + ln(tf)) * (ln((1.0 + (SELECT n FROM n)) / (1 + df)) + 1) AS raw FROM tf JOIN vocab USING (term)),
weights AS (SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight FROM raw)"""


@query(f"WITH n AS (SELECT count(*) AS n FROM documents), {RUNS}, {VOCAB}, {WEIGHTS} SELECT id, term, round(weight, 6) AS weight FROM weights")
def tfidf_trigrams(spark, sf):
    """Weights of runs of one to three words."""
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), text.tokens(F.col("text")).alias("w"))
    return vectorize.run_tfidf(docs, "w", 3, docs.count()).select("id", "term", F.round("weight", 6).alias("weight"))


COLS = f"""{PAIRS_SQL}, docs AS (SELECT conv_id * 1000 + turn AS id, {tok('query')} AS q, {tok('title')} AS p FROM turn_pairs), n AS (SELECT count(*) AS n FROM docs),
tf AS (SELECT side, id, term, count(*) AS tf FROM (SELECT 'a' AS side, id, unnest(list_concat(q, p)) AS term FROM docs UNION ALL SELECT 'q', id, unnest(q) FROM docs UNION ALL SELECT 'p', id, unnest(p) FROM docs) GROUP BY 1, 2, 3),
vocab AS (SELECT term FROM tf WHERE side = 'a' GROUP BY term HAVING count(*) >= 3 AND count(*) <= 0.75 * (SELECT n FROM n)),
df AS (SELECT side, term, count(*) AS df FROM tf GROUP BY 1, 2),
raw AS (SELECT side, id, term, (1 + ln(tf)) * (ln((1.0 + (SELECT n FROM n)) / (1 + df)) + 1) AS raw FROM tf JOIN vocab USING (term) JOIN df USING (side, term)),
w AS (SELECT side, id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY side, id)) AS weight FROM raw)"""


@query(f"WITH {COLS} SELECT d.id, round(coalesce(s.similarity, 0.0), 6) AS similarity FROM docs d LEFT JOIN (SELECT a.id, sum(a.weight * b.weight) AS similarity FROM w a JOIN w b ON a.side = 'q' AND b.side = 'p' AND a.id = b.id AND a.term = b.term GROUP BY a.id) s ON s.id = d.id")
def row_cosine(spark, sf):
    """Similarity of query and reply: one vocabulary of both, frequencies of each field by itself."""
    rows = turn_pairs(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), text.tokens(F.col("query")).alias("q"), text.tokens(F.col("title")).alias("p"))
    rows = rows.withColumn("all", F.concat("q", "p"))
    n = rows.count()
    tf = {c: vectorize.counts(vectorize.term_rows(rows, c)) for c in ("all", "q", "p")}
    vocab = vectorize.vocabulary(tf["all"], n)
    weights = {c: vectorize.tfidf(tf[c], vocab, n, refit=True) for c in ("q", "p")}
    return vectorize.row_cosine(weights["q"], weights["p"], rows.select("id")).select("id", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {PAIRS_SQL}, n AS (SELECT count(*) AS n FROM turn_pairs), t AS (SELECT conv_id * 1000 + turn AS id, {tok('query')} AS q, {tok('title')} AS p FROM turn_pairs),
terms AS (SELECT id, unnest(flatten(list_transform(q, lambda x: list_transform(p, lambda y: x || 'X' || y)))) AS term FROM t), tf AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY 1, 2),
{VOCAB}, {WEIGHTS} SELECT id, term, round(weight, 6) AS weight FROM weights""")
def cooccurrence_tfidf(spark, sf):
    """Weights of joined query and reply words, with a vocabulary of their own."""
    rows = turn_pairs(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), text.tokens(F.col("query")).alias("q"), text.tokens(F.col("title")).alias("p"))
    weights = vectorize.pair_tfidf(rows.select("id", F.col("q").alias("a"), F.col("p").alias("b")), rows.count())
    return vectorize.pair_terms(weights).select("id", "term", F.round("weight", 6).alias("weight"))


STACK = f"""{PAIRS_SQL}, docs AS (SELECT conv_id * 1000 + turn AS id, {tok('query')} AS q, {tok('title')} AS p FROM turn_pairs), n AS (SELECT 2 * count(*) AS n FROM docs),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT 'q:' || id AS id, unnest(q) AS term FROM docs UNION ALL SELECT 'p:' || id, unnest(p) FROM docs) GROUP BY 1, 2)"""


@query(f"WITH {STACK}, {VOCAB}, {WEIGHTS} SELECT id, term, round(weight, 6) AS weight FROM weights")
def stacked_fields(spark, sf):
    """Weights of queries and replies under one vocabulary that is fitted on both, below each other."""
    rows = turn_pairs(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), text.tokens(F.col("query")).alias("q"), text.tokens(F.col("title")).alias("p"))
    rows = vectorize.stacked_rows(rows, ["q", "p"]).select(F.concat_ws(":", "field", "id").alias("id"), "words")
    n = rows.count()
    tf = vectorize.counts(vectorize.term_rows(rows, "words"))
    return vectorize.tfidf(tf, vectorize.vocabulary(tf, n), n).select("id", "term", F.round("weight", 6).alias("weight"))


@query("WITH p AS (SELECT DISTINCT lang FROM documents WHERE source < 'src5'), k AS (SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INT) AS index FROM p) SELECT doc_id AS id, index, 1 AS value FROM documents JOIN k USING (lang)")
def one_hot_ids(spark, sf):
    """A 1 at the place of each document's language among those of some sources."""
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    return vectorize.one_hot(docs, "lang", docs.where("source < 'src5'"))


@query("SELECT doc_id AS id, CAST(doc_id % 3 AS INT) AS index, 1.0::DOUBLE AS value FROM documents UNION ALL SELECT doc_id, CAST(3 + doc_id % 4 AS INT), 2.0::DOUBLE FROM documents")
def stacked_blocks(spark, sf):
    """Two sparse blocks side by side."""
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    block = lambda m, v: docs.select("id", (F.col("id") % m).cast("int").alias("index"), F.lit(v).alias("value"))
    return vectorize.stacked_width([block(3, 1.0), block(4, 2.0)])


@query("WITH s AS (SELECT avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1, avg(l_tax) AS m2, stddev_pop(l_tax) AS s2 FROM lineitem) SELECT l_orderkey, l_linenumber, round((l_quantity - m1) / s1, 6) AS l_quantity, round((l_tax - m2) / s2, 6) AS l_tax FROM lineitem, s")
def standardized_columns(spark, sf):
    """Columns with mean 0 and deviation 1."""
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    out = vectorize.standardized(rows, ["l_quantity", "l_tax"])
    return out.select("l_orderkey", "l_linenumber", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_tax", 6).alias("l_tax"))


def _vectors(spark, sf):
    rows = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 4 + 1).cast("int").alias("r"), F.col("label").alias("q"), F.col("embedding").cast("array<double>").alias("value"))
    return rows


def _pool_sql(x: str, empty: float, by: str = "") -> str:
    stats = ", ".join(f"round(coalesce({f}, {empty}), 6) AS {n}_{r}" for r in (1, 2, 3, 4) for n, f in (("mean", f"avg(x) FILTER (r = {r})"), ("std", f"stddev_pop(x) FILTER (r = {r})"), ("min", f"min(x) FILTER (r = {r})"), ("median", f"quantile_cont(x, 0.5) FILTER (r = {r})"), ("max", f"max(x) FILTER (r = {r})")))
    return f"""WITH v AS (SELECT vec_id AS id, CAST(label % 4 + 1 AS INT) AS r, label AS q, CAST(embedding AS DOUBLE[]) AS value FROM embeddings),
m AS (SELECT a.id, b.r, {x} AS x FROM v a LEFT JOIN v b ON a.id <> b.id {by}) SELECT id, {stats} FROM m GROUP BY id"""


def _pooled(rows, metric, empty, key=None):
    out = pooling.pooled_stats(rows, rows, metric, key=key, empty=empty)
    return out.select("id", *[F.round(c, 6).alias(c) for c in out.columns if c != "id"])


@query(_pool_sql("list_cosine_similarity(a.value, b.value)", 0.0, "AND a.q = b.q"))
def pooled_cosine(spark, sf):
    """Similarity to the labelled vectors of the same group, by class."""
    return _pooled(_vectors(spark, sf), "cosine", 0.0, "q")


@query(_pool_sql("list_cosine_similarity(a.value, b.value)", 0.0))
def pooled_cosine_by_class(spark, sf):
    """Similarity to all labelled vectors, by class."""
    return _pooled(_vectors(spark, sf), "cosine", 0.0)


@query(_pool_sql("list_distance(a.value, b.value)", -1.0, "AND a.q = b.q"))
def pooled_euclidean(spark, sf):
    """Distance to the labelled vectors of the same group, by class."""
    return _pooled(_vectors(spark, sf), "euclidean", -1.0, "q")


@query(_pool_sql("list_distance(a.value, b.value)", -1.0))
def pooled_euclidean_by_class(spark, sf):
    """Distance to all labelled vectors, by class."""
    return _pooled(_vectors(spark, sf), "euclidean", -1.0)


def _set_sql(metric: str, value: str, grams: str, by: str) -> str:
    """Statistics of a set similarity by class, from counts of shared distinct terms."""
    x = {"jaccard": "CASE WHEN a.n + b.n > 0 THEN coalesce(s.n, 0) / CAST(a.n + b.n - coalesce(s.n, 0) AS DOUBLE) ELSE 0.0 END", "dice": "CASE WHEN a.n + b.n > 0 THEN 2 * coalesce(s.n, 0) / CAST(a.n + b.n AS DOUBLE) ELSE 0.0 END"}[metric]
    stats = ", ".join(f"round(coalesce({f}, 0.0), 6) AS {n}_{r}" for r in (1, 2, 3, 4) for n, f in (("mean", f"avg(x) FILTER (r = {r})"), ("std", f"stddev_pop(x) FILTER (r = {r})"), ("min", f"min(x) FILTER (r = {r})"), ("median", f"quantile_cont(x, 0.5) FILTER (r = {r})"), ("max", f"max(x) FILTER (r = {r})")))
    terms = {"unigram": "w", "bigram": bi("w"), "trigram": tri("w")}[grams]
    return f"""WITH {SAMPLES_SQL}, t AS (SELECT id, query AS q, relevance AS r, {tok(value)} AS w FROM samples), v AS (SELECT id, q, r, list_distinct({terms}) AS value, len(list_distinct({terms})) AS n FROM t),
e AS (SELECT id, q, unnest(value) AS term FROM v), s AS (SELECT a.id AS i, b.id AS j, count(*) AS n FROM e a JOIN e b ON a.term = b.term AND a.id <> b.id {by} GROUP BY 1, 2),
m AS (SELECT a.id, b.r, {x} AS x FROM v a LEFT JOIN v b ON a.id <> b.id {by} LEFT JOIN s ON s.i = a.id AND s.j = b.id) SELECT id, {stats} FROM m GROUP BY id"""


def _set_pool(metric: str, value: str, grams: str, key: str | None):
    def run(spark, sf):
        words = text.tokens(F.col(value))
        rows = samples(spark, sf).select("id", F.col("query").alias("q"), F.col("relevance").alias("r"), ngrams.GRAMS[grams](words).alias("value"))
        return _pooled(rows, metric, 0.0, key)

    run.__doc__ = f"The metric {metric} of {grams}s of {value}s with the labelled ones{' of the same query' if key else ''}, by class."
    return run


for _metric in ("jaccard", "dice"):
    for _value in ("title", "description"):
        for _grams in ngrams.GRAMS:
            for _key in (None, "q"):
                _name = f"pooled_{_metric}_{_value}_{_grams}_by_{'query' if _key else 'class'}"
                QUERIES[_name] = _set_pool(_metric, _value, _grams, _key)
                ORACLES[_name] = _set_sql(_metric, _value, _grams, "AND a.q = b.q" if _key else "")


@query(f"""WITH {SAMPLES_SQL}, v AS (SELECT id, query AS q, relevance AS r, {tok('title')} AS value FROM samples),
m AS (SELECT a.id, b.r, {jac('a.value', 'b.value')} AS x FROM v a LEFT JOIN v b ON a.id <> b.id AND a.q = b.q)
SELECT id, {', '.join(f'round(coalesce({f}, 0.0), 6) AS {n}_{r}' for r in (1, 2, 3, 4) for n, f in (('mean', f'avg(x) FILTER (r = {r})'), ('std', f'stddev_pop(x) FILTER (r = {r})'), ('min', f'min(x) FILTER (r = {r})'), ('median', f'quantile_cont(x, 0.5) FILTER (r = {r})'), ('max', f'max(x) FILTER (r = {r})')))} FROM m GROUP BY id""")
def pooled_jaccard(spark, sf):
    """Set similarity of titles to the labelled titles of the same query, by class."""
    rows = samples(spark, sf).select("id", F.col("query").alias("q"), F.col("relevance").alias("r"), text.tokens(F.col("title")).alias("value"))
    return _pooled(rows, "jaccard", 0.0, "q")


@query()
def latent_vectors(spark, sf):
    """Singular vectors of the benchmark's weights, rows projected."""
    rows = read(spark, sf, "benchmark").select(F.col("item_id").alias("id"), text.tokens(F.col("text")).alias("w"))
    n = rows.count()
    tf = vectorize.counts(vectorize.term_rows(rows, "w"))
    vocab = vectorize.vocabulary(tf, n)
    weights = vectorize.tfidf(tf, vocab, n)
    terms = lsa.indexed_terms(vocab)
    _, v = lsa.fit_svd(weights.withColumnRenamed("id", "row"), terms, 5)
    return lsa.project(weights, terms, v)


def _pair_sql(q: str, t: str, g: str) -> str:
    left = {"unigram": "query", "bigram": bi("query"), "id": "['qid' || qid]"}[q]
    return CO(left, t if g == "unigram" else bi(t))


SAMPLE_WORDS = f"{SAMPLES_SQL}, t AS (SELECT id, id % 7 AS qid, {', '.join(f'{tok(f)} AS {f}' for f in FIELDS)} FROM samples)"
TWELVE = [(q, t, g) for q in ("unigram", "bigram", "id") for t in ("title", "description") for g in ("unigram", "bigram")]


def _twelve(spark, sf) -> tuple[DataFrame, dict]:
    """Samples with words, and the left and right terms of each column."""
    rows = tokenized(samples(spark, sf), *FIELDS).withColumn("qid", F.col("id") % 7)
    left = {"unigram": F.col("query_tokens"), "bigram": ngrams.bigrams(F.col("query_tokens")), "id": F.array(F.concat(F.lit("qid"), F.col("qid")))}
    right = {"unigram": lambda w: w, "bigram": ngrams.bigrams}
    return rows, {f"{q}_{t}_{g}": (left[q], right[g](F.col(f"{t}_tokens"))) for q, t, g in TWELVE}


@query(f"WITH {SAMPLE_WORDS} SELECT id, {', '.join(f'md5({_pair_sql(*x)}) AS {chr(95).join(x)}' for x in TWELVE)} FROM t")
def cooccurrence_columns(spark, sf):
    """Digests of all twelve columns of joined terms: query words, word pairs or id with words or word pairs of title and description."""
    rows, columns = _twelve(spark, sf)
    held = rows.withColumns({f"{f}_bigrams": ngrams.bigrams(F.col(f"{f}_tokens")) for f in FIELDS})  # once for all columns
    bigrams = lambda f, g, x: F.col(f"{f}_bigrams") if g == "bigram" else x
    columns = {"_".join(x): tuple(bigrams(f, g, c) for f, g, c in zip(("query", x[1]), (x[0], x[2]), columns["_".join(x)], strict=True)) for x in TWELVE}
    return held.select("id", *[F.md5(ngrams.cooccurrence_text(a, b).cast("binary")).alias(n) for n, (a, b) in columns.items()])


_LONG = " UNION ALL ".join(f"SELECT '{'_'.join(x)}' AS col, id, unnest(string_split({_pair_sql(*x)}, ' ')) AS term FROM t" for x in TWELVE)


@query(f"""WITH {SAMPLE_WORDS}, n AS (SELECT count(*) AS n FROM t), terms AS ({_LONG}), tf AS (SELECT col, id, term, count(*) AS tf FROM terms WHERE term <> '' GROUP BY 1, 2, 3),
vocab AS (SELECT col, term, count(*) AS df FROM tf GROUP BY 1, 2 HAVING count(*) >= 3 AND count(*) <= 0.75 * (SELECT n FROM n)),
raw AS (SELECT col, id, term, (1 + ln(tf)) * (ln((1.0 + (SELECT n FROM n)) / (1 + df)) + 1) AS raw FROM tf JOIN vocab USING (col, term))
SELECT col, id, count(*) AS n_terms, round(sum(raw) / sqrt(sum(raw * raw)), 6) AS total FROM raw GROUP BY col, id""")
def cooccurrence_weights(spark, sf):
    """Terms and summed weights of each row in all twelve columns of joined terms, each with a vocabulary of its own."""
    rows, columns = _twelve(spark, sf)
    path = scratch(spark, "words")  # words are found once for all columns
    rows.select("id", "qid", *[f"{f}_tokens" for f in FIELDS]).write.parquet(path)
    rows = spark.read.parquet(path)
    n, out = rows.count(), None
    for name, (a, b) in columns.items():
        part = vectorize.pair_tfidf(rows.select("id", a.alias("a"), b.alias("b")), n).where(F.size("weight") > 0)
        total = F.aggregate("weight", F.lit(0.0), lambda s, w: s + w)
        part = part.select(F.lit(name).alias("col"), "id", F.size("weight").cast("long").alias("n_terms"), F.round(total, 6).alias("total"))
        out = part if out is None else out.unionByName(part)
    return out
