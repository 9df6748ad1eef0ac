"""Fusion of two ranked lists per query, and removal of repeated hits.

A list has the columns ``query_id, id, score, hit_rank`` (rank from 1). Both sides meet in one full outer join on
query and document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def side(hits: DataFrame, source: str) -> DataFrame:
    """The distinct hits of one source as a list, the best of each document; null scores count as 0."""
    rows = hits.where(F.col("source") == source).select("query_id", F.col("doc_id").alias("id"), F.coalesce("score", F.lit(0.0)).alias("score"))
    best = rows.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return best.withColumn("hit_rank", F.row_number().over(order).cast("long"))


def joined(first: DataFrame, second: DataFrame) -> DataFrame:
    a = first.select("query_id", "id", F.col("score").alias("s1"), F.col("hit_rank").alias("r1"))
    b = second.select("query_id", "id", F.col("score").alias("s2"), F.col("hit_rank").alias("r2"))
    return a.join(b, ["query_id", "id"], "full")


def weighted_merge(first: DataFrame, second: DataFrame, weight: float) -> DataFrame:
    """Weighted mean of a document found on both sides; a one-sided one keeps its raw score."""
    both = F.col("s1").isNotNull() & F.col("s2").isNotNull()
    score = F.when(both, F.col("s1") * weight + F.col("s2") * (1 - weight)).otherwise(F.coalesce("s1", "s2"))
    kind = F.when(both, "hybrid").when(F.col("s1").isNotNull(), "keyword").otherwise("semantic")
    return joined(first, second).select("query_id", "id", score.alias("score"), kind.alias("found_by"))


def reciprocal_rank(first: DataFrame, second: DataFrame, k: int = 60) -> DataFrame:
    """Sum of ``1 / (k + rank)`` over the sides, rank from 1."""
    part = lambda r: F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0))
    return joined(first, second).select("query_id", "id", (part("r1") + part("r2")).alias("score"), F.coalesce(F.col("r1") - 1, F.lit(-1)).alias("first_rank"), F.coalesce(F.col("r2") - 1, F.lit(-1)).alias("second_rank"))


def normalised_merge(first: DataFrame, second: DataFrame, weight: float | Column) -> DataFrame:
    """Scores scaled per query to [0, 1] (first by its maximum, second to its range), weighted, a missing side as 0."""
    per = Window.partitionBy("query_id")
    a = first.withColumn("score", F.when(F.max("score").over(per) > 0, F.col("score") / F.max("score").over(per)).otherwise(0.0))
    low, high = F.min("score").over(per), F.max("score").over(per)
    b = second.withColumn("score", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0))
    w = F.lit(weight) if not isinstance(weight, Column) else weight
    return joined(a, b).select("query_id", "id", (w * F.coalesce("s1", F.lit(0.0)) + (1 - w) * F.coalesce("s2", F.lit(0.0))).alias("score"))


def ranked(fused: DataFrame, k: int, digits: int = 6) -> DataFrame:
    fused = fused.withColumn("score", F.round("score", digits))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return fused.withColumn("hit_rank", F.row_number().over(order).cast("long")).where(F.col("hit_rank") <= k)


def first_of_each(hits: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first hit of each query and key; later ones are repeats."""
    w = Window.partitionBy("query_id", key).orderBy(*order)
    return hits.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def id_or_prefix(size: int = 100) -> Column:
    """The document id, or where it is blank the first characters of the content."""
    return F.coalesce(F.when(F.col("doc_id") != "", F.col("doc_id")), F.substring(F.coalesce("content", F.lit("")), 1, size))
