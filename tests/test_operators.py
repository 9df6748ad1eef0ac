import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.operators import chunking, evaluation, fusion, keyword, questions, ranking, vectors
from quillspark.streaming import sessions


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize("base, expected", [(50.0, 42.5 + 1 + 0.15 + 0.01), (49.99, 37.4925 + 1.5 + 0.35 + 0.015), (20.0, 15 + 1.5 + 0.35 + 0.015), (19.99, 11.994 + 3 + 0.25 + 0.025)])
def test_tiers_change_at_their_bounds(spark, base, expected):
    got = one(spark, ranking.tiered(F.col("b"), F.lit(10.0), F.lit(1.0), F.lit(1.0), ranking.FIRST_TIERS, (5.0, 0.5)), b=base)
    assert got == pytest.approx(expected)


def test_exact_title_is_additive_and_capped(spark):
    score = ranking.title_priority_exact(F.col("q"), F.col("c"), F.col("s"))
    assert one(spark, score, q="abc", c="abc", s="") == 50.0
    assert one(spark, score, q="abc", c="", s="x abc") == pytest.approx(20 + 6)
    assert one(spark, score, q="xyz", c="细胞", s="") == pytest.approx(1.0)


def test_title_words_share(spark):
    score = ranking.title_priority(F.col("q"), F.col("c"), F.col("s"))
    assert one(spark, score, q="alpha beta", c="only beta here", s="") == pytest.approx(5.0)
    assert one(spark, score, q="腺癌", c="腺癌的诊断", s="腺癌") == pytest.approx(10 + 8 + 4)


def test_description_penalises_short_figures(spark):
    kind, confidence, flag = ranking.description(F.col("t"), F.lit(""))
    assert one(spark, confidence, t="图表所示：细胞呈圆形，可见核仁") == pytest.approx((0.2 + 3 * 0.08) / 2)
    assert one(spark, flag, t="图表所示：细胞呈圆形，可见核仁") is False
    assert one(spark, kind, t="") == "general"


@pytest.mark.parametrize("raw, highest, expected", [(0.5, 9.0, 0.5), (4.0, 8.0, 0.5), (5.0, 0.0, 0.5), (55.0, 0.0, 0.95), (1000.0, 0.0, 0.98)])
def test_relevance_scales(spark, raw, highest, expected):
    assert one(spark, ranking.relevance(F.col("r"), F.col("h")), r=raw, h=highest) == pytest.approx(expected)


def test_metrics_at_k(spark):
    m = {k: one(spark, v, e=["a", "b", "b"], r=["a", "a", "c", "b"]) for k, v in evaluation.at_k(F.col("e"), F.col("r"), F.lit(3)).items()}
    assert m == {"recall": 0.5, "precision": pytest.approx(1 / 3), "f1": pytest.approx(0.4), "hit_rate": 1.0}
    assert one(spark, evaluation.at_k(F.col("e"), F.col("r"), F.lit(3))["recall"], e=[], r=["a"]) == 0.0


def test_longest_entity_first(spark):
    assert one(spark, questions.entities(F.col("q")), q="肺腺癌和腺癌的转移") == ["肺腺癌", "腺癌", "转移"]
    assert one(spark, questions.entities(F.col("q")), q="肺腺癌") == ["肺腺癌"]


def test_stop_phrases_in_order(spark):
    assert one(spark, questions.without_stop_phrases(F.col("q")), q="腺癌 的 特征是什么吗") == "腺癌 特征"


def test_fallback_keywords(spark):
    assert one(spark, questions.fallback_keywords(F.col("q")), q="CK7 ck7 什么 细胞核") == ["CK7", "细胞核"]
    assert one(spark, questions.fallback_keywords(F.col("q")), q="？！") == ["？！"]


def test_fusion_is_symmetric_and_keeps_one_sided(spark):
    rows = [("q", "a", 3.0, "x"), ("q", "b", 1.0, "x"), ("q", "b", 0.5, "y"), ("q", "c", 0.9, "y")]
    hits = spark.createDataFrame(rows, "query_id string, doc_id string, score double, source string")
    x, y = fusion.side(hits, "x"), fusion.side(hits, "y")
    forth = {r["id"]: r["score"] for r in fusion.reciprocal_rank(x, y).collect()}
    back = {r["id"]: r["score"] for r in fusion.reciprocal_rank(y, x).collect()}
    assert forth == pytest.approx(back)
    merged = {r["id"]: (round(r["score"], 6), r["found_by"]) for r in fusion.weighted_merge(x, y, 0.6).collect()}
    assert merged == {"a": (3.0, "keyword"), "b": (0.8, "hybrid"), "c": (0.9, "semantic")}


def test_bm25_of_one_term(spark):
    docs = spark.createDataFrame([(1, "细胞 cell"), (2, "nothing"), (3, None)], "id long, text string")
    terms = keyword.query_terms(spark.createDataFrame([("q", "Cell")], "query_id string, question string"))
    (row,) = keyword.bm25_scores(terms, docs, "id", "text").collect()
    mean = (3 + 1 + 0) / 3
    assert row["score"] == pytest.approx(math.log(1 + 2.5 / 1.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / mean)))


def test_fuzzy_terms_equal_brute_force(spark):
    words = ["cell", "cells", "sell", "carcinoma", "carcinomas", "karzinoma", "arcinom", "nucleus", "nuclei", "abc", "ab"]
    terms = ["cell", "carcinoma", "nucleus", "abd", "ab"]
    got = {(r["term"], r["word"], r["distance"]) for r in keyword.fuzzy_terms(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(w,) for w in words], "word string")).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[j - 1] + 1, row[j - 1] + (x != y)))
        return out

    want = {(t, w, distance(t, w)) for t in terms for w in words if distance(t, w) <= (0 if len(t) <= 2 else 1 if len(t) <= 5 else 2)}
    assert got == want


def test_exact_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(99, None)], "vec_id long, embedding array<float>").repartition(5)
    got = vectors.exact_topk(df, df.where("vec_id % 10 = 0"), 4).collect()
    for q in range(0, 60, 10):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        want = sorted(range(60), key=lambda i: (round(d[i], 6), i))[:4]
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["hit_rank"]) if r["query_vec"] == q] == want


def test_inverted_file_recall(spark):
    folder = "/root/testdata/sf0.001"
    v = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    q = v.where("vec_id % 100 = 0")
    exact = {(r["query_vec"], r["vec_id"]) for r in vectors.exact_topk(v, q, 10).collect()}
    found = {(r["query_vec"], r["vec_id"]) for r in vectors.ivf_topk(v, q, 10).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_sections_carry_titles(spark):
    text = "before\n# 第一章 A\nx\n## 第一节 B\ny\n\ny2\n## free\nz\n# 第二章 C\nw"
    rows = chunking.sections(spark.createDataFrame([("d", text), ("e", None), ("f", "")], "id string, text string"), "id", "text").orderBy("section_no").collect()
    assert [(r["chapter"], r["section"], r["page_no"], r["body"]) for r in rows] == [("", "", 1, "before"), ("第一章 A", "", 2, "x"), ("第一章 A", "第一节 B", 3, "y\ny2"), ("第一章 A", "free", 3, "z"), ("第二章 C", "", 4, "w")]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab 。.\n，", max_size=2500))
def test_boundary_pieces_rejoin(text):
    joined = "".join("".join(p.split()) for p in chunking.boundary_split(text))
    assert joined == "".join(text.split())


def test_boundary_split_prefers_near_marks():
    text = "字" * 480 + "。" + "字" * 600
    assert len(chunking.boundary_split(text)[0]) == 481
    assert len(chunking.boundary_split("字" * 800)) == 1
    assert [len(p) for p in chunking.boundary_split("字" * 801)] == [500, 301]


def test_streams_equal_their_batch_forms(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    for name, form, keys in (("responses", sessions.model_totals, ["model_used"]), ("events", None, None)):
        source = spark.read.parquet(f"{folder}/{name}.parquet")
        part = str(tmp_path / name)
        source.repartition(3).write.parquet(part)
        stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(part)
        if form:
            query = form(stream).writeStream.outputMode("complete").format("memory").queryName(f"out_{name}").trigger(availableNow=True).start()
            assert query.awaitTermination(60)
            assert sorted(map(tuple, spark.table(f"out_{name}").collect()), key=str) == sorted(map(tuple, form(source).collect()), key=str)
        else:
            query = sessions.windowed_counts(stream, late="3650 days").writeStream.outputMode("complete").format("memory").queryName("out_events").trigger(availableNow=True).start()
            assert query.awaitTermination(60)
            assert spark.table("out_events").agg(F.sum("events")).collect()[0][0] == source.where("ts IS NOT NULL").count()


def test_session_state(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{folder}/query_log.parquet").select("session_id", "query_id", "asked_at")
    part = str(tmp_path / "log")
    source.repartition(2).write.parquet(part)
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(part)
    query = sessions.session_totals(stream).writeStream.outputMode("update").format("memory").queryName("out_sessions").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    got = {r["session_id"]: r["n"] for r in spark.table("out_sessions").groupBy("session_id").agg(F.max("queries").alias("n")).collect()}
    assert got == {r["session_id"]: r["n"] for r in source.groupBy("session_id").agg(F.countDistinct("query_id").alias("n")).collect()}
