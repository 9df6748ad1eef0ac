"""Expected documents are searched in the tasks that hold them, with the rows of the SQL."""

import duckdb

from quillspark.operators import best
from quillspark.plans import registry

from test_queries import comparable
from test_whole_jobs import HITS, folder_of


def test_texts_are_not_joined_with_their_pieces(spark, tmp_path, monkeypatch):
    for name, size in (("ROWS", 1), ("QUERIES", 3)):
        monkeypatch.setattr(best, name, size)
    words = ["signet", "ring", "核仁", "x7", "腺癌", "ring cell", "a", "核"]
    hits = [(k // 2 if k % 5 == 0 else 1000 + k, " ".join(words[(k * m) % 8] for m in range(1, 1 + k % 5)), k % 2, words[k % 8], None if k % 3 else words[k % 7], "c") for k in range(70)]
    hits += [(None, "signet ring", 1, "", "", "c"), (7, "腺癌", 1, "腺", "癌", "c"), (8, None, 1, "ring", "", "c")]
    asked = [(f"q{k}", [words[k % 8], words[(k * 3) % 8], None][: k % 4]) for k in range(30)] + [("q1", ["signet", "signet"]), ("q40", ["x7", "不"]), ("q41", None), ("q42", ["l 腺"])]
    folder = folder_of(spark, tmp_path, search_results=(hits, HITS), questions=(asked, "id string, keywords array<string>"))
    df = registry.QUERIES["expected_chunk_mapping"](spark, folder)
    con = duckdb.connect()
    for t in ("search_results", "questions"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    result = con.execute(registry.SQL["expected_chunk_mapping"])
    at = [[d[0] for d in result.description].index(c) for c in df.columns]
    assert sorted(repr(tuple(comparable(v) for v in row)) for row in df.collect()) == sorted(repr(tuple(comparable(row[i]) for i in at)) for row in result.fetchall())
    assert "head" not in df._jdf.queryExecution().optimizedPlan().toString()
