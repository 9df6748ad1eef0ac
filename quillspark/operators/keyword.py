"""Keyword retrieval: BM25 over term postings, field boosts, phrases, fuzzy terms and term logic.

A search takes a frame of queries and a frame of documents. Only postings of the queries' terms are
formed: documents keep their length as a column, their tokens are exploded, joined with the distinct query
terms and counted. Corpus size and mean length are scalar subqueries. Of the sums of a query each task keeps only its best
before they are ranked (Spark limits the groups of a ranking window locally).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import any_of, token_count, tokens
from quillspark.session import broadcast_if_small, cut_lineage

K1, B = 1.2, 0.75


def query_terms(queries: DataFrame, id_column: str = "query_id", text_column: str = "question") -> DataFrame:
    """Distinct ``(query_id, term)``."""
    return queries.select(F.col(id_column).alias("query_id"), F.explode(tokens(F.col(text_column))).alias("term")).distinct()


def field_scores(terms: DataFrame, documents: DataFrame, id_column: str, fields: list[str]) -> DataFrame:
    """``(query_id, id, field, score, matched)``: BM25 of each field, all fields in one pass over the documents.

    Query terms meet the tokens without a shuffle as long as there are few of them, so that a very frequent term is no hot
    key; the token counts of a document are summed up in the task that reads it. Beyond that the join is by shuffle.
    """
    texts = [F.coalesce(f, F.lit("")) for f in fields]
    docs = documents.select(F.col(id_column).alias("id"), *[tokens(t).alias(f"tokens{k}") for k, t in enumerate(texts)])
    corpus = documents.agg(F.struct(F.count("*").alias("n"), *[F.avg(token_count(t)).alias(f"mean{k}") for k, t in enumerate(texts)])).scalar()
    wanted = broadcast_if_small(terms.select("term").distinct())
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.size(f"tokens{k}").alias("length"), F.col(f"tokens{k}").alias("tokens")) for k in range(len(fields))])
    rows = docs.select("id", F.explode(each).alias("x")).select("id", "x.k", "x.length", F.explode("x.tokens").alias("term"))
    # read twice below, for the frequencies and for the scores: the texts are cut into tokens once
    postings = cut_lineage(rows.join(wanted, "term").groupBy("k", "term", "id", "length").agg(F.count("*").alias("tf")))
    frequency = postings.groupBy("k", "term").agg(F.count("*").alias("df"))
    n, mean = corpus["n"], F.array(*[corpus[f"mean{k}"] for k in range(len(fields))])
    weight = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * (K1 + 1) * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.get(mean, F.col("k"))))
    scored = postings.join(frequency, ["k", "term"]).withColumn("w", weight).select("k", "term", "id", "w")
    sums = scored.join(broadcast_if_small(terms), "term").groupBy("query_id", "id", "k").agg(F.sum("w").alias("score"), F.count("*").alias("matched"))
    return sums.select("query_id", "id", F.get(F.array(*[F.lit(f) for f in fields]), F.col("k")).alias("field"), "score", "matched")


def bm25_scores(terms: DataFrame, documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(query_id, id, score, matched)``: sum of BM25 over the terms of each query, and how many of its terms occur."""
    return field_scores(terms, documents, id_column, [text_column]).drop("field")


def top_hits(scores: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The ``k`` best of each query by rounded score, ties by id."""
    rounded = scores.withColumn("score", F.round("score", digits))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return rounded.withColumn("hit_rank", F.row_number().over(best).cast("long")).where(F.col("hit_rank") <= k)


def best_field_scores(terms: DataFrame, documents: DataFrame, id_column: str, boosts: dict[str, float]) -> DataFrame:
    """The best boosted field of each document."""
    scores = field_scores(terms, documents, id_column, list(boosts))
    return scores.groupBy("query_id", "id").agg(F.max(_boosted(boosts)).alias("score"))


def _boosted(boosts: dict[str, float]) -> Column:
    factors = F.create_map(*[x for field, boost in boosts.items() for x in (F.lit(field), F.lit(float(boost)))])
    return F.col("score") * factors[F.col("field")]


def should_scores(scores: DataFrame, clauses: list[tuple[tuple[str, ...], float]]) -> DataFrame:
    """``(query_id, id, score)``: the sum over clauses of a clause's boost times its best field, of ``field_scores``; a document needs one clause."""
    total = F.lit(0.0)
    for fields, boost in clauses:
        total = total + F.coalesce(F.max(F.when(F.col("field").isin(list(fields)), F.col("score"))), F.lit(0.0)) * boost
    summed = scores.groupBy("query_id", "id").agg(total.alias("score"))
    return summed.where("score > 0")


def constant_scores(scores: DataFrame, boosts: dict[str, float]) -> DataFrame:
    """``(query_id, id, score)``: for each field that holds any of the terms its constant boost, whatever the frequencies."""
    factors = F.create_map(*[x for field, boost in boosts.items() for x in (F.lit(field), F.lit(float(boost)))])
    return scores.where(F.col("field").isin(list(boosts))).groupBy("query_id", "id").agg(F.sum(factors[F.col("field")]).alias("score"))


def without_subtypes(hits: DataFrame, asked_for: Column, texts: list[str], subtypes: list[str]) -> DataFrame:
    """Hits of queries for which ``asked_for`` holds lose those that name a subtype in any of the texts."""
    named = F.lit(False)
    for t in texts:
        named = named | any_of(F.coalesce(t, F.lit("")), subtypes)
    return hits.where(~(asked_for & named))


def filtered_weights(rules: list[tuple[Column, float]]) -> Column:
    """Product of the weights of all rules that hold."""
    out = F.lit(1.0)
    for condition, weight in rules:
        out = out * F.when(condition, weight).otherwise(1.0)
    return out


def all_terms(terms: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores of the documents that hold every term of a query."""
    needed = terms.groupBy("query_id").agg(F.count("*").alias("needed"))
    return scores.join(needed, "query_id").where("matched = needed").select("query_id", "id", "score")


def fuzzy_terms(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(term, word, distance)``: words of the vocabulary within the edit distance that a term's length allows.

    Up to two characters allow none, up to five one, more two edits; terms and words meet by length
    classes and a shared half, so the vocabulary is never compared as a whole: with at most two edits in
    a word of at least six characters, or one in at least three, one of three (two) equal parts stays intact.
    """
    allowed = lambda c: F.when(F.length(c) <= 2, 0).when(F.length(c) <= 5, 1).otherwise(2)

    def parts(c: Column, n: Column) -> Column:
        """Starts of the parts of a term, cut by its own length."""
        return F.transform(F.sequence(F.lit(0), n), lambda k: F.struct((F.floor(F.length(c) * k / (n + 1)) + 1).cast("int").alias("at"), (F.floor(F.length(c) * (k + 1) / (n + 1)) - F.floor(F.length(c) * k / (n + 1))).cast("int").alias("size")))

    asked = terms.select("term").distinct().withColumn("edits", allowed("term"))
    cut = asked.select("term", "edits", F.explode(parts(F.col("term"), F.col("edits"))).alias("p")).select("term", "edits", "p.at", F.expr("substring(term, p.at, p.size)").alias("piece"))
    # a piece may stand up to `edits` characters away in the word
    keys = cut.select("term", "edits", "piece", F.explode(F.sequence(F.greatest(F.lit(1), F.col("at") - F.col("edits")), F.col("at") + F.col("edits"))).alias("at"), F.length("piece").alias("size"))
    sizes = keys.select("size").distinct()
    grams = vocabulary.select("word").distinct().join(broadcast_if_small(sizes), F.col("size") <= F.length("word")).select("word", "size", F.explode(F.sequence(F.lit(1), F.length("word") - F.col("size") + 1)).alias("at"))
    grams = grams.select("word", "size", "at", F.expr("substring(word, at, size)").alias("piece"))
    met = keys.join(grams, ["piece", "at", "size"]).where(F.abs(F.length("term") - F.length("word")) <= F.col("edits")).select("term", "word", "edits").distinct()
    return met.withColumn("distance", F.levenshtein("term", "word").cast("long")).where("distance <= edits").select("term", "word", "distance")
