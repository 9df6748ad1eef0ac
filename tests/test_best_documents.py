"""Searches keep their best in the tasks: pairs of query and document are never listed, and the rows are those of the SQL."""

import duckdb
import pytest

from quillspark.operators import best, keyword
from quillspark.plans import registry

from test_queries import comparable
from test_whole_jobs import HITS, folder_of

NAMES = [
    "function_score",
    "hybrid_search_v2",
    "keyword_search_v3",
    "should_sum",
    "variant_search",
    "keyword_search_v1",
    "bm25_topk",
    "distance_fusion",
    "hybrid_search_v1",
    "keyword_search_v2",
    "multi_field_best",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    words = ["signet", "ring", "cell", "核", "仁", "x7", "图 3", "carcinoma", "adeno", "腺癌"]
    text = lambda k: " ".join(words[(k * m + k // 7) % len(words)] for m in range(1, 3 + k % 9))
    # ids of several contents, of the same content on two pages, and none
    hits = [(k // 2 if k % 5 == 0 else 1000 + k, text(k), k % 3, text(k + 1)[:12] or None, None if k % 4 else text(k + 3)[:9], "c") for k in range(90)]
    hits += [(7, "signet ring", 1, "a", "b", "c"), (7, "signet ring", 2, "a", "b", "c"), (None, "signet 核 ring", 1, "", "", "c"), (8, "", 1, "", "", "c"), (9, None, 1, "", "", "c")]
    docs = [(k, text(k + 2), text(k)[:20]) for k in range(260)] + [(5, "signet ring cell", "t"), (6, None, "t"), (300, "腺癌 图像", "腺癌 病理"), (400, "ring", "")]
    log = [(f"q_{k}", text(k // 100)) for k in range(0, 1200, 100)] + [("q_100", "腺癌 signet"), ("q_101", "ring"), ("q_200", None)]
    vectors = [(k, [float(k % 7), float(k % 3), 1.0]) for k in range(0, 301, 20)]
    return folder_of(
        spark, tmp_path_factory.mktemp("best"), search_results=(hits, HITS), documents=(docs, "doc_id long, text string, title string"), query_log=(log, "query_id string, question string"), embeddings=(vectors, "vec_id long, embedding array<float>")
    )


@pytest.mark.parametrize("name", NAMES)
def test_no_pairs_of_query_and_document_are_listed(spark, folder, monkeypatch, name):
    def listed(*_):
        raise AssertionError("lists every pair of a query and a document")

    monkeypatch.setattr(keyword, "field_scores", listed)
    monkeypatch.setattr(best, "ROWS", 16)
    monkeypatch.setattr(best, "QUERIES", 5)
    df = registry.QUERIES[name](spark, folder)
    con = duckdb.connect()
    for t in ("search_results", "documents", "query_log", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    result = con.execute(registry.SQL[name])
    columns = [d[0] for d in result.description]
    at = [columns.index(c) for c in df.columns]
    assert sorted(repr(tuple(comparable(v) for v in row)) for row in df.collect()) == sorted(repr(tuple(comparable(row[i]) for i in at)) for row in result.fetchall())
