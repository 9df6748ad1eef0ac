"""Queries over small tables made for what an earlier form left out."""


import duckdb

from quillspark.plans import registry

HITS = "doc_id long, content string, page_number int, chapter_title string, section_title string, collection string"


def folder_of(spark, tmp_path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_related_chunks_need_no_shared_word(spark, tmp_path):
    rows = [(1, "核仁明显", 1, "甲", "一", "c"), (2, "胞质丰富", 1, "甲", "一", "c"), (3, "核仁明显 x", 1, "甲", "二", "c"), (4, "背景　坏死", 1, "甲", "二", "c"), (5, "坏死", 1, "甲", "三", "c"), (6, "另一章", 1, "乙", "一", "c"), (7, "无题", 1, "", "", "c"), (8, "", 1, None, None, "c")]
    got = {}
    for r in sorted(registry.QUERIES["related_chunks_all"](spark, folder_of(spark, tmp_path, search_results=(rows, HITS))).collect(), key=lambda r: (r["doc_id"], r["nth"])):
        got.setdefault(r["doc_id"], []).append((r["other_id"], r["score"]))
    assert got == {1: [(2, 10.0), (3, 5.0), (4, 0.0)], 2: [(1, 10.0), (3, 0.0), (4, 0.0)], 3: [(4, 10.0), (1, 2.5), (2, 0.0)], 4: [(3, 10.0), (5, 2.5), (1, 0.0)], 5: [(4, 5.0), (1, 0.0), (2, 0.0)], 7: [(8, 10.0)], 8: [(7, 10.0)]}


def test_related_chunks_of_a_full_section_stay_in_it(spark, tmp_path):
    rows = [(i, f"w{i}", 1, "甲", "一", "c") for i in range(1, 6)] + [(9, "w1", 1, "甲", "二", "c")]
    got = registry.QUERIES["related_chunks_all"](spark, folder_of(spark, tmp_path, search_results=(rows, HITS))).where("doc_id IN (1, 9)").collect()
    assert sorted((r["doc_id"], r["nth"], r["other_id"], r["score"]) for r in got) == [(1, 1, 2, 10.0), (1, 2, 3, 10.0), (1, 3, 4, 10.0), (9, 1, 1, 5.0), (9, 2, 2, 0.0), (9, 3, 3, 0.0)]


def test_expected_documents_by_related_concepts_in_any_case_and_without_hits(spark, tmp_path):
    hits = [(1, "Signet ring", 1, "", "", "c"), (2, "腺癌", 1, "SIGNET", None, "c"), (3, "核x", 1, None, None, "c")]
    asked = [("q1", ["signet"], ["腺癌"]), ("q2", None, ["核"]), ("q3", [], None), ("q4", ["没有", None], []), ("q5", [""], [])]
    folder = folder_of(spark, tmp_path, search_results=(hits, HITS), questions=(asked, "id string, keywords array<string>, related_concepts array<string>"))
    got = {}
    for r in sorted(registry.QUERIES["expected_chunk_mapping_all"](spark, folder).collect(), key=lambda r: (r["question_id"], r["nth"])):
        got.setdefault(r["question_id"], []).append((r["doc_id"], r["points"]))
    picks = {q: got.pop(q) for q in ("q3", "q4")}
    assert got == {"q1": [(2, 5), (1, 2)], "q2": [(3, 2)], "q5": [(1, 5), (2, 5), (3, 5)]}
    assert all(len({d for d, _ in p}) == 2 and {x for _, x in p} == {0} for p in picks.values())
    con = duckdb.connect()
    for name in ("search_results", "questions"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    rows = con.execute(f"SELECT question_id, doc_id FROM ({registry.SQL['expected_chunk_mapping_all']}) WHERE points = 0").fetchall()
    assert sorted(rows) == sorted((q, d) for q, p in picks.items() for d, _ in p)
