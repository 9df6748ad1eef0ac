"""Retrieval metrics at k, their summaries and breakdowns, and coverage of an evaluation set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at_k(expected: Column, retrieved: Column, k: Column) -> dict[str, Column]:
    """Recall, precision (of k, not of what was retrieved), F1 and hit rate of id lists; repeated ids count once."""
    wanted = F.array_distinct(expected)
    found = F.size(F.array_intersect(wanted, F.slice(retrieved, F.lit(1), k)))
    recall = F.when(F.size(wanted) > 0, found / F.size(wanted)).otherwise(0.0)
    precision = F.when(k > 0, found / k).otherwise(0.0)
    f1 = F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0)
    return {"recall": recall, "precision": precision, "f1": f1, "hit_rate": F.when(found > 0, 1.0).otherwise(0.0)}


def metrics(results: DataFrame, ks: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """One row per result and k."""
    rows = results.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    none = F.array().cast("array<string>")
    values = at_k(F.coalesce("expected_chunk_ids", none), F.coalesce("retrieved_chunk_ids", none), F.col("k"))
    return rows.select("question_id", "method", "success", "k", *[v.alias(n) for n, v in values.items()])


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, fractions: dict[str, float], slices: int = 1024) -> DataFrame:
    """``keys`` and one column for each of ``fractions``: quantiles with linear interpolation, as a sort of each group would give them.

    Two passes instead of a sort: counts of ``slices`` equal slices of a group's range tell in which slices the wanted places lie,
    and only the distinct values of those are put in order. No group is gathered in one task. Nulls are left out.
    """
    id_ = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    values = rows.where(F.col(value).isNotNull()).select(id_.alias("_group"), *keys, F.col(value).cast("double").alias("_v"))
    groups = values.groupBy("_group", *keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_n"))
    place = F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * slices)
    sliced = values.select("_group", "_v").join(groups.select("_group", "_low", "_high"), "_group").withColumn("_slice", F.when(F.col("_high") > F.col("_low"), F.least(place, F.lit(slices - 1))).otherwise(0))
    counts = sliced.groupBy("_group", "_slice", "_v").agg(F.count("*").alias("_c"))
    totals = counts.groupBy("_group", "_slice").agg(F.sum("_c").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("_group").orderBy("_slice")) - F.col("_c")
    totals = totals.withColumn("_before", before)
    at = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(float(f)) * (F.col("_n") - 1)).alias("at")) for name, f in fractions.items()]))
    wanted = groups.select("_group", at.alias("_q")).select("_group", "_q.name", "_q.at", F.explode(F.array(F.floor("_q.at"), F.ceil("_q.at"))).alias("rank")).distinct()
    spots = wanted.join(totals, "_group").where("rank >= _before AND rank < _before + _c").select("_group", "_slice", "name", "at", "rank", "_before")
    near = counts.join(spots.select("_group", "_slice").distinct(), ["_group", "_slice"], "left_semi")
    upto = F.sum("_c").over(Window.partitionBy("_group", "_slice").orderBy("_v"))
    found = near.withColumn("_upto", upto).join(spots, ["_group", "_slice"]).where("rank < _before + _upto AND rank >= _before + _upto - _c")
    ends = found.groupBy("_group", "name", "at").agg(F.min_by("_v", "rank").alias("low"), F.max_by("_v", "rank").alias("high"))
    lines = ends.select("_group", "name", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))).alias("v"))
    wide = lines.groupBy("_group").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in fractions])
    return groups.join(wide, "_group").select(*keys, *fractions)


def with_quantiles(aggregated: DataFrame, rows: DataFrame, keys: list[str], value: str, fractions: dict[str, float], digits: int = 6) -> DataFrame:
    """``aggregated`` with the rounded quantiles of its groups."""
    found = exact_quantiles(rows, keys, value, fractions).select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.round(q, digits).alias(q) for q in fractions])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return aggregated.join(found, same, "left").drop(*[f"_{k}" for k in keys])


def summary(rows: DataFrame, keys: list[str], columns: list[str], digits: int = 6) -> DataFrame:
    """Mean, population deviation, least, greatest and median of each column, in long form."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
    long = rows.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.metric", "x.value")
    out = {"mean": F.avg("value"), "std": F.stddev_pop("value"), "least": F.min("value"), "greatest": F.max("value")}
    grouped = long.groupBy(*keys, "metric").agg(*[F.round(c, digits).alias(n) for n, c in out.items()], F.count("value").alias("n"))
    return with_quantiles(grouped, long, [*keys, "metric"], "value", {"median": 0.5}, digits)


def first_hit_rank(expected: Column, retrieved: Column) -> Column:
    """Rank of the first retrieved id that is expected; null if there is none."""
    ranked = F.transform(retrieved, lambda x, i: F.when(F.array_contains(expected, x), i + 1))
    return F.array_min(F.filter(ranked, lambda r: r.isNotNull()))
