"""Related documents are compared in the tasks, with the rows of the SQL."""

import duckdb
import pytest

from quillspark.operators import related
from quillspark.plans import registry

from test_queries import comparable
from test_whole_jobs import HITS, folder_of


@pytest.mark.parametrize("name", ["related_chunks", "related_chunks_all"])
def test_one_row_of_the_chapter_a_document_and_no_pairs(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(related, "OWN", 7)
    monkeypatch.setattr(related, "CELLS", 1)
    words = ["signet", "ring", "cell", "核", "x7", "carcinoma"]
    rows = [(k, " ".join(words[(k * m) % 6] for m in range(1, 1 + k % 5)), k % 2, "ab"[k % 2], ["一", "二", "三", None][k % 4], "c") for k in range(40)]
    # ids of several contents, titles and pages, contents without words, none of an id
    rows += [(3, "cell ring", 1, "b", "二", "c"), (3, "cell ring", 2, "b", "二", "c"), (3, "x7 cell", 1, "a", "一", "c"), (50, " ", 1, "", None, "c"), (51, "", 1, None, "", "c"), (None, "ring", 1, "a", "一", "c"), (53, "ring\x0bcell\u3000x7", 1, "a", "一", "c"), (54, "\u3000cell\u3000", 1, "a", "一", "c"), (52, "alone", 1, "only", "一", "c")]
    folder = folder_of(spark, tmp_path, search_results=(rows, HITS))
    df = registry.QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW search_results AS SELECT * FROM '{folder}/search_results.parquet/*.parquet'")
    result = con.execute(registry.SQL[name])
    at = [[d[0] for d in result.description].index(c) for c in df.columns]
    assert sorted(repr(tuple(comparable(v) for v in row)) for row in df.collect()) == sorted(repr(tuple(comparable(row[i]) for i in at)) for row in result.fetchall())
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "other_section" not in plan and "other_w" not in plan and plan.count("word") == 0
