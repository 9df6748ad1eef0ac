"""Readers and writers of files, and structure operators, on hand-made texts."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import chunking as C
from quillspark.operators import keyword
from quillspark.operators import structure as S
from quillspark.sources import files


def test_markdown_as_a_whole_and_by_lines(spark, tmp_path):
    (tmp_path / "a.md").write_text("# 第一章\r\nText\n\nlast", encoding="utf-8")
    (tmp_path / "b.md").write_text("", encoding="utf-8")
    assert [r["text"] for r in files.markdown_texts(spark, f"{tmp_path}/a.md").collect()] == ["# 第一章\r\nText\n\nlast"]
    lines = files.markdown_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r["line_no"], r["line"]) for r in lines] == [(1, "# 第一章\r\n"), (2, "Text\n"), (3, "\n"), (4, "last")]


def test_chunks_and_questions(spark, tmp_path):
    chunk = {"chunk_id": "chunk_0001", "content": "细胞", "chapter_title": "c", "section_title": "s", "page_number": 3, "metadata": {"a": "b"}}
    path = tmp_path / "chunks.json"
    path.write_text(json.dumps([chunk, chunk | {"chunk_id": "chunk_0002"}]), encoding="utf-8")
    chunks = files.chunks_json(spark, str(path))
    assert [r["chunk_id"] for r in chunks.orderBy("chunk_id").collect()] == ["chunk_0001", "chunk_0002"]
    assert files.chunks_json(spark, str(tmp_path / "none.json")).count() == 0
    files.write_chunks_json(chunks, str(tmp_path / "again"))
    assert files.chunks_json(spark, str(tmp_path / "again"), by_line=True).count() == 2
    good = tmp_path / "q.json"
    good.write_text(json.dumps([{"id": "1", "question": "q", "keywords": ["k"]}]), encoding="utf-8")
    assert files.questions_json(spark, str(good)).first()["keywords"] == ["k"]
    bad = tmp_path / "bad.json"
    bad.write_text(json.dumps([{"id": "1", "colour": "red"}]), encoding="utf-8")
    with pytest.raises(ValueError):
        files.questions_json(spark, str(bad))
    broken = tmp_path / "broken.json"
    broken.write_text('[{"id": "1", "keywords": "no list"}]', encoding="utf-8")
    with pytest.raises(Exception):
        files.questions_json(spark, str(broken)).collect()


def test_knowledge(spark, tmp_path):
    path = tmp_path / "k.json"
    path.write_text(json.dumps({"chapters": [{"number": "1", "title": "t"}], "diseases": [{"name": "腺癌", "category": "c", "features": ["f"]}], "concepts": ["a", "b"], "images": [], "features": ["f"]}), encoding="utf-8")
    parts = files.knowledge_json(spark, str(path))
    assert {k: v.count() for k, v in parts.items()} == {"chapters": 1, "diseases": 1, "concepts": 2, "images": 0, "features": 1}


def test_stores(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, "old"), ("b", 5, "old"), ("d", 2, "old")], "id string, at int, v string")
    new = spark.createDataFrame([("a", 2, "new"), ("b", 4, "late"), ("c", None, "new"), ("d", 2, "new")], "id string, at int, v string")
    assert {r["id"]: r["v"] for r in files.upsert(old, new, "id", "at").collect()} == {"a": "new", "b": "old", "c": "new", "d": "new"}
    vectors = spark.createDataFrame([(1, [0.5, 1.0])], "vec_id long, embedding array<double>")
    files.append_vectors(vectors, f"{tmp_path}/v", 2)
    files.append_vectors(vectors, f"{tmp_path}/v", 2)
    assert spark.read.parquet(f"{tmp_path}/v").count() == 2
    with pytest.raises(Exception):
        files.append_vectors(vectors, f"{tmp_path}/v", 3)
    files.rebuild(old, vectors, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/chunks").count() == 3


def test_chapter_update(spark):
    stored = spark.createDataFrame([("a", "", "x"), ("b", "old", ""), ("c", None, None)], "doc_id string, chapter_title string, section_title string")
    found = spark.createDataFrame([("a", "new", " "), ("b", "", ""), ("z", "q", "")], "doc_id string, chapter_title string, section_title string")
    out, counts = files.update_chapters(stored, found)
    assert {r["doc_id"]: (r["chapter_title"], r["section_title"], r["has_chapter_info"]) for r in out.collect()} == {"a": ("new", "x", True), "b": ("old", "", True), "c": (None, None, False)}
    assert counts.first().asDict() == {"processed": 3, "updated": 1, "failed": 1}


def test_reports(spark, tmp_path):
    summary = spark.createDataFrame([(5, 0.8, 0.1, 0.2, 0.9), (3, 0.4, 0.1, 0.2, 0.9)], "k int, recall double, precision double, f1 double, hit_rate double")
    text = files.markdown_summary(summary)
    assert "| 5 | 0.800 | 0.100 | 0.200 | 0.900 |" in text and text.endswith("Retrieval is good.")
    assert files.markdown_summary(summary.where("k = 3")).endswith("needs work.")
    files.write_report(summary, summary, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/details")).count() == 2
    lines = spark.createDataFrame([("b", 2, "d", 1, "x"), ("b", None, "d", 1, "y"), ("b", 2, "d", 2, "z")], "book string, page_number int, doc_id string, line_no int, line string")
    assert [r["line"] for r in files.page_lines(lines, "book").orderBy("book", "page", "doc_id", "line_no").collect()] == ["#### 第0页", "y", "#### 第2页", "x", "z"]


def one(spark, expression, text):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("x")).first()["x"]


def test_titles_figures_and_json(spark):
    assert one(spark, S.clean_title, "第一节 鳞癌.....12 页") == "第一节 鳞癌"
    assert one(spark, S.section_name, "## 第二节鳞癌··· 7") == "第二节 鳞癌"
    assert [one(spark, S.figure_label, t) for t in ("见图 3-12a", "图7", "图三b", "表3")] == ["3-12a", "7", "三b", None]
    for text, want in (('{"k": 1}', "whole"), ('so:\n```json\n{"k": 1}\n```', "fenced"), ('is {"k": 1}.', "braced"), ("is {k", "none"), ("", "none")):
        assert one(spark, lambda c: S.embedded_json(c)[1], text) == want
    options = one(spark, S.inline_options, "腺癌 的 特征 top_k=7 search_type=odd model=m x=y")
    assert options.asDict() == {"question": "腺癌 的 特征 x=y", "top_k": 7, "search_type": "hybrid", "model": "m"}
    assert one(spark, S.inline_options, "q top_k=many")["top_k"] == 5
    chapter, section = (one(spark, lambda c, k=k: S.titles_in(c)[k], "正文\n# 细胞的章\nx") for k in (0, 1))
    assert (chapter, section) == ("细胞的章", "") and one(spark, lambda c: S.titles_in(c)[0], "正文\n第三章 鳞癌\n第一节 x") == "第三章 鳞癌"
    phrases = S.feature_phrases(spark.createDataFrame([(1, "ROSE特征：核大，'深染明显'，短\n无")], "id int, t string"), "id", "t")
    assert {r["phrase"] for r in phrases.collect()} == {"深染明显"}


BOOK = """前面的话
# 目 录
第一章 甲 ..... 1 第一节 子 ..... 2 第二节 丑 ..... 5
第二章 乙 ..... 9
参考文献
丢掉
# 第一章 旧名
引言
## 第一节 旧子
文一
## 第二节 旧丑
文二
## 第三节 多出
文三
# 第二章 旧乙
只有正文
# 第三章 末章 99
尾声""".split("\n")


def test_sections_take_the_titles_of_the_contents_by_order(spark):
    lines = spark.createDataFrame([("b", k, t) for k, t in enumerate(BOOK)] + [("other", 1, "no contents")], "id string, pos int, line string")
    got = {(r["chapter_no"], r["section_no"]): (r["chapter"], r["section"], r["lines"]) for r in S.chunks_by_contents(lines).collect()}
    assert got == {
        (0, 0): ("前言", "前言", 1),
        (1, 1): ("第一章 甲", "第一节 子", 2),
        (1, 2): ("第一章 甲", "第二节 丑", 1),
        (1, 3): ("第一章 甲", "第三节 多出", 1),
        (2, 1): ("第二章 乙", "第二章 乙", 1),
        (3, 1): ("第三章 末章", "第三章 末章", 1),
    }


def test_boundaries_are_measured_at_the_marks(spark):
    text = "x" * 498 + "。" + "y" + "。" + "z" * 600
    assert [len(p) for p in C.boundary_split(text)][0] == 501
    far = "x" * 420 + "\n\n" + "y" * 70 + "。" + "z" * 600
    assert len(C.boundary_split(far)[0]) == 500 - 2 + 2
    near = "x" * 460 + "\n\n" + "y" * 600
    assert len(C.boundary_split(near)[0]) == 460


def test_clauses_add_up_and_constants_do_not_count_frequencies(spark):
    docs = spark.createDataFrame([("a", "red red", "blue"), ("b", "", "red"), ("c", None, None)], "id string, title string, body string")
    terms = spark.createDataFrame([("q", "red")], "query_id string, term string")
    scores = keyword.field_scores(terms, docs, "id", ["title", "body"])
    single = {(r["id"], r["field"]): r["score"] for r in scores.collect()}
    assert set(single) == {("a", "title"), ("b", "body")}
    for field in ("title", "body"):
        alone = keyword.bm25_scores(terms, docs, "id", field).first()
        assert single[alone["id"], field] == pytest.approx(alone["score"])
    summed = {r["id"]: r["score"] for r in keyword.should_scores(scores, [(("title",), 2.0), (("title", "body"), 1.0)]).collect()}
    assert summed == {"a": pytest.approx(3 * single["a", "title"]), "b": pytest.approx(single["b", "body"])}
    assert {r["id"]: r["score"] for r in keyword.constant_scores(scores, {"title": 2.5, "body": 2.0}).collect()} == {"a": 2.5, "b": 2.0}
