from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import splitting as sp

SCHEMA = "doc_id string, content string, chapter_title string, section_title string, body string, piece string"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .。\n；，字", max_size=900), st.integers(20, 120), st.integers(0, 15))
def test_pieces_cover_the_text_within_the_limit(text, limit, overlap):
    pieces = sp.split_text(text, limit, overlap)
    assert "".join(text[max(s, e0) : e] for (s, e, _), e0 in zip(pieces, [0, *[e for _, e, _ in pieces]], strict=False)) == text
    for (s, e, kind), nxt in zip(pieces, [*pieces[1:], None], strict=False):
        assert 0 < e - s <= limit
        if nxt:
            assert s < nxt[0] <= e < nxt[1]
            assert e - nxt[0] == overlap or nxt[1] - nxt[0] == limit or e < overlap
            assert kind in ("natural", "forced")


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="a。字", min_size=1, max_size=400), st.integers(10, 60))
def test_forced_only_where_no_natural_cut_is_in_reach(text, limit):
    kinds = {k for *_, k in sp.split_text(text, limit, 3)}
    if len(text) > limit:
        ends = [0, *[i + 1 for i, c in enumerate(text) if c == "。" and text[i + 1 : i + 2] != "。"], len(text)]
        assert ("forced" in kinds) == any(b - a > limit for a, b in zip(ends, ends[1:], strict=False))


def test_least_total_cost_balances_sizes():
    text = "".join("字" * 99 + "。" for _ in range(12))
    assert [(s, e) for s, e, _ in sp.split_text(text, 800, 0)] == [(0, 600), (600, 1200)]


def test_table_results(spark):
    rows = [("n", "句。" * 500, "c", "s", "x", "y"), ("n", "句。" * 500, "c", "s", "x", "y"), ("f", " \n" + "字" * 801 + "\r\n", None, "", "x", "y"), ("w", "字" * 800, "c", None, "x", "y"), ("0", None, "c", "s", "x", "y"), ("1", "", "c", "s", "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    pieces = sp.split_oversized(df).collect()
    assert {r["doc_id"] for r in pieces} == {"n", "f", "w"}
    assert all(len(r["piece"]) == r["n_chars"] <= 800 for r in pieces)
    assert {(r["doc_id"], r["chapter_title"], r["section_title"]) for r in pieces} == {("n", "c", "s"), ("f", None, ""), ("w", "c", None)}
    assert {r["doc_id"]: r["cut_kind"] for r in pieces if r["cut_kind"] == "forced"} == {"f": "forced"}
    assert len([r for r in pieces if r["doc_id"] == "n"]) == 2
    assert sp.split_oversized(df.limit(0)).count() == 0
    long = spark.createDataFrame([("l", "很长的一句话，没有停顿。" * 20_000, "c", "s", "x", "y")], SCHEMA)
    assert max(r["n_chars"] for r in sp.split_oversized(long).select("n_chars").collect()) <= 800


def test_found_equals_sql_on_test_tables(spark):
    import duckdb

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW search_results AS SELECT * FROM '{folder}/search_results.parquet'")
    assert sorted(map(tuple, sp.p3_found(spark, folder).collect())) == sorted(con.execute(sp.SQL["p3_found"]).fetchall())
