"""Forms that are taken at scale give what the plain ones give."""

import numpy as np
import pytest

from quillspark.operators import keyword, vectors
from quillspark.operators.evaluation import exact_quantiles
from quillspark.session import broadcast_if_small, ensure_checkpoint_dir


def test_quantiles_in_two_passes_equal_a_sort(spark):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=700), "b": np.repeat(2.5, 40), "c": np.array([7.0]), None: rng.integers(0, 5, 300).astype(float), "d": np.concatenate([np.zeros(500), [1e9]])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["median"], r["p95"]) for r in exact_quantiles(df, ["g"], "v", {"median": 0.5, "p95": 0.95}, slices=16).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g] == pytest.approx((np.quantile(values, 0.5), np.quantile(values, 0.95)))


def test_many_queries_meet_the_vectors_in_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(size=6)]) for k in range(300)] + [(900, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 7 = 0")
    plain = {metric: sorted(map(tuple, vectors.exact_topk(df, asked, 4, metric).collect())) for metric in ("l2", "cosine")}
    monkeypatch.setattr(vectors, "BLOCK", 10)
    monkeypatch.setattr(vectors, "SLICE", 60)
    for metric, want in plain.items():
        assert sorted(map(tuple, vectors.exact_topk(df, asked, 4, metric).collect())) == want


def test_terms_beyond_the_broadcast_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"red word{k % 3} blue") for k in range(20)], "id long, t string")
    terms = spark.createDataFrame([("q", "red"), ("q", "word1"), ("p", "blue")], "query_id string, term string")
    want = sorted((r["query_id"], r["id"], round(r["score"], 9)) for r in keyword.bm25_scores(terms, docs, "id", "t").collect())
    monkeypatch.setattr(keyword, "broadcast_if_small", lambda df: df)
    assert sorted((r["query_id"], r["id"], round(r["score"], 9)) for r in keyword.bm25_scores(terms, docs, "id", "t").collect()) == want


def test_small_sides_only_are_broadcast(spark):
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(broadcast_if_small(spark.range(5), 5)).lower()
    assert "broadcast" not in plan(broadcast_if_small(spark.range(6), 5)).lower()


def test_a_checkpoint_folder_is_made_only_in_local_mode():
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                class Sc:
                    @staticmethod
                    def getCheckpointDir():
                        class Option:
                            @staticmethod
                            def isDefined():
                                return False

                        return Option

                return Sc

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session)
