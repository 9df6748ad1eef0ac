"""Vector search: exact top-k in blocks of queries, and an inverted-file index.

Exact search compares every vector with a stated set of queries. Up to ``BLOCK`` queries are broadcast; a task
multiplies its Arrow batches with them and keeps its own k best of each query, so the shuffle carries k rows per
task and query, however many vectors there are. More queries are cut into blocks of that size, and slices of the
vectors meet the blocks in a distributed join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
#: Vectors that meet a block of queries in one task where there are several blocks.
SLICE = 20_000


def _matrix(series: pd.Series) -> np.ndarray:
    return np.array(series.tolist(), dtype=np.float64)


def _nearest(ids: np.ndarray, queries: np.ndarray, batches: Iterator[pd.DataFrame], k: int, metric: str) -> pd.DataFrame:
    """The k nearest vectors of the batches for each query, and those as near as the k-th (ties are decided by id later)."""
    kept_id = np.zeros((len(ids), 0), np.int64)
    kept = np.zeros((len(ids), 0))
    for batch in batches:
        if not len(batch):
            continue
        x, xid = _matrix(batch["embedding"]), batch["vec_id"].to_numpy(np.int64)
        if metric == "l2":
            d = np.maximum(0.0, (queries**2).sum(1)[:, None] - 2 * queries @ x.T + (x**2).sum(1)[None, :])
        else:
            d = 1 - (queries @ x.T) / np.maximum(1e-300, np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :])
        kept = np.hstack([kept, d])
        kept_id = np.hstack([kept_id, np.broadcast_to(xid, d.shape)])
        if kept.shape[1] > 2 * k:
            limit = np.partition(kept, k - 1, axis=1)[:, k - 1 : k] + 1e-9
            width = int((kept <= limit).sum(1).max())
            order = np.argsort(kept, axis=1, kind="stable")[:, :width]
            kept, kept_id = np.take_along_axis(kept, order, 1), np.take_along_axis(kept_id, order, 1)
    return pd.DataFrame({"query_vec": np.repeat(ids, kept.shape[1]), "vec_id": kept_id.reshape(-1), "distance": kept.reshape(-1)})


_FOUND = "query_vec long, vec_id long, distance double"


def _block_topk(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, metric: str) -> DataFrame:
    """One block of queries, broadcast, against the vectors where they are."""
    shared = vectors.sparkSession.sparkContext.broadcast((ids, queries))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield _nearest(*shared.value, batches, k, metric)

    return vectors.select("vec_id", "embedding").mapInPandas(run, _FOUND)


def _paired_topk(vectors: DataFrame, queries: DataFrame, blocks: int, k: int, metric: str) -> DataFrame:
    """Slices of ``SLICE`` vectors meet blocks of queries, each pair in a task of its own; nothing passes the driver."""
    slices = max(1, -(-vectors.count() // SLICE))
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    left = vectors.select("vec_id", "embedding", place(slices).alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    # names of their own: both sides may come from one table
    right = queries.select(F.col("vec_id").alias("query_vec"), F.col("embedding").alias("query"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), place(blocks).alias("block"))

    def run(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query_vec": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "distance": np.zeros(0)})
        return _nearest(q["query_vec"].to_numpy(np.int64), _matrix(q["query"]), iter([x]), k, metric)

    return left.groupBy("slice", "block").cogroup(right.groupBy("slice", "block")).applyInPandas(run, _FOUND)


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", digits: int = 6) -> DataFrame:
    """``(query_vec, vec_id, distance, hit_rank)``: the k nearest vectors of each query (squared L2, or one minus cosine)."""
    rows = queries.where("embedding IS NOT NULL").select("vec_id", "embedding")
    vectors = vectors.where("embedding IS NOT NULL")
    count = rows.count()
    if count <= BLOCK:
        block = rows.orderBy("vec_id").toPandas()
        parts = _block_topk(vectors, block["vec_id"].to_numpy(np.int64), _matrix(block["embedding"]), k, metric) if count else vectors.sparkSession.createDataFrame([], "query_vec long, vec_id long, distance double")
    else:
        parts = _paired_topk(vectors, rows, -(-count // BLOCK), k, metric)
    best = Window.partitionBy("query_vec").orderBy("distance", "vec_id")
    return parts.withColumn("distance", F.round("distance", digits) + 0.0).withColumn("hit_rank", F.row_number().over(best).cast("long")).where(F.col("hit_rank") <= k)


def fit_centroids(vectors: DataFrame, lists: int, sample_rows: int = 50_000, seed: int = 7) -> np.ndarray:
    """k-means centroids of a bounded sample (the vectors with the least hashes of their ids)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    share = min(1.0, sample_rows / max(1, n))
    sample = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(share * 1_000_000)).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=min(lists, max(1, n)), seed=seed, maxIter=10).fit(sample)
    return np.array(model.clusterCenters())


def assign_lists(vectors: DataFrame, centroids: np.ndarray, probes: int = 1) -> DataFrame:
    """Each vector with its ``probes`` nearest lists."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for batch in batches:
            if len(batch):
                x = _matrix(batch["embedding"])
                d = (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None, :]
                near = np.argsort(d, axis=1)[:, :probes]
                yield pd.DataFrame({"vec_id": np.repeat(batch["vec_id"].to_numpy(np.int64), near.shape[1]), "list_id": near.reshape(-1).astype(np.int64), "embedding": np.repeat(batch["embedding"].to_numpy(), near.shape[1])})

    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInPandas(run, "vec_id long, list_id long, embedding array<double>")


def ivf_topk(vectors: DataFrame, queries: DataFrame, k: int, lists: int = 16, probes: int = 11) -> DataFrame:
    """Inverted-file search: queries meet the vectors of their nearest lists only."""
    vectors = vectors.where("embedding IS NOT NULL")
    centroids = fit_centroids(vectors, lists)
    index = assign_lists(vectors, centroids)
    asked = assign_lists(queries.where("embedding IS NOT NULL"), centroids, probes).select(F.col("vec_id").alias("query_vec"), "list_id", F.col("embedding").alias("q"))
    distance = F.aggregate(F.zip_with("embedding", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x)
    met = index.join(asked, "list_id").select("query_vec", "vec_id", F.round(distance, 6).alias("distance"))
    best = Window.partitionBy("query_vec").orderBy("distance", "vec_id")
    return met.withColumn("hit_rank", F.row_number().over(best).cast("long")).where(F.col("hit_rank") <= k)
